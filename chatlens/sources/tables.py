"""Reading and writing tables, and the checks made on their columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens import fixed_values as fv
from chatlens.session import materialise

_CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read CSV with a header and quoted, possibly multi-line text."""
    return (
        spark.read.schema(schema).options(**_CSV_OPTIONS).option("multiLine", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.options(**_CSV_OPTIONS).option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write
    if partition_by:
        # One task per value would be a bottleneck for two roles, so rows keep
        # their partitioning and each task writes one file per value it holds.
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail at plan time when a column is missing."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise KeyError(f"missing column(s): {', '.join(missing)}")
    return df


def ensure_column(df: DataFrame, name: str, default: Column | None = None, kind: str = "string") -> DataFrame:
    """Add a column with a default value (null if none is given) when it is absent."""
    if name in df.columns:
        return df
    return df.withColumn(name, (F.lit(None) if default is None else default).cast(kind))


def nullify_na_tokens(df: DataFrame, columns: Sequence[str], na_tokens: Sequence[str] = fv.NA_TOKENS) -> DataFrame:
    """Turn missing-value strings into null, as data-frame CSV readers do."""
    listed = list(na_tokens)
    return df.withColumns({c: F.when(~F.col(c).isin(listed), F.col(c)) for c in columns})


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Open a Parquet, JSON or CSV table by the ending of its path."""
    ending = PurePosixPath(path).suffix
    if ending == ".csv":
        return spark.read.options(**_CSV_OPTIONS).option("multiLine", True).csv(path)
    if ending == ".json":
        return spark.read.json(path)
    return spark.read.parquet(path)


def register_tables(
    spark: SparkSession,
    base: Mapping[str, str],
    extra: Sequence[str] = (),
    read=read_any,
) -> list[str]:
    """Register files as temporary views and return the names.

    ``base`` maps names to paths, and missing ones are skipped. Each ``extra``
    entry is ``name=path`` or a path whose stem becomes the name, and must exist.
    """
    names = []
    for name, path in base.items():
        try:
            read(spark, path).createOrReplaceTempView(name)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        names.append(name)
    for entry in extra:
        name, found, path = entry.partition("=")
        if not found:
            name, path = PurePosixPath(entry).stem, entry
        try:
            read(spark, path).createOrReplaceTempView(name)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(f"table '{name}' not found at {path}") from error
            raise
        names.append(name)
    return names


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Number the rows 0, 1, 2, … in their present order, as a stored table.

    The rows are written once with (partition, position). The start of each
    partition follows from the partition counts, so no row passes through a
    single task; only one count per partition does.
    """
    mono = F.monotonically_increasing_id()
    stored = materialise(
        df.withColumn("_index_at", mono).select(
            "*", F.shiftright("_index_at", 33).cast("int").alias("_index_part"), F.col("_index_at").bitwiseAND((1 << 33) - 1).alias("_index_pos")
        ).drop("_index_at"),
        "row-index",
    )
    sizes = stored.groupBy("_index_part").agg(F.count("*").alias("_index_n"))
    # This window sees one row per partition of the input, never the rows themselves.
    before = Window.orderBy("_index_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_index_part", F.coalesce(F.sum("_index_n").over(before), F.lit(0)).alias("_index_start"))
    return (
        stored.join(F.broadcast(starts), "_index_part")
        .withColumn(name, F.col("_index_start") + F.col("_index_pos"))
        .drop("_index_part", "_index_pos", "_index_start")
    )
