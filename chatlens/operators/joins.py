"""A keyed join and an exact median that hold up when one key or group is huge."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.session import materialise

HOT_ROWS = 1_000_000
NULL_SPLITS = 4096


def text_key(text: Column) -> Column:
    """A short join key for a long text."""
    return F.sha2(text, 256)


def attach_by_key(
    left: DataFrame,
    right: DataFrame,
    key: str | Sequence[str],
    counts: DataFrame,
    spread_by: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join to a right side that has one row per key.

    ``counts(key…, n_rows)`` says how often a key occurs on the left. Keys above
    ``hot_rows`` are split: left rows get a salt from a hash of ``spread_by``
    and the one right row is repeated once per salt. The list of hot keys (at
    most ``total rows / hot_rows``) is stored, so that Spark knows its size and
    broadcasts it only if it is below the threshold.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hot = materialise(counts.filter(F.col("n_rows") > hot_rows).select(
        *keys, F.ceil(F.col("n_rows") / hot_rows).cast("int").alias("_splits")
    ), "hot-keys")
    splits = F.coalesce("_splits", F.lit(1))
    # Rows without a key match nothing, so they may go anywhere: spread them too.
    no_key = functools.reduce(operator.or_, [F.col(k).isNull() for k in keys])
    left_splits = F.when(no_key, F.lit(NULL_SPLITS)).otherwise(splits)
    salted_left = left.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), left_splits).cast("int")
    ).drop("_splits")
    salted_right = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), splits - 1))
    ).drop("_splits")
    return salted_left.join(salted_right, [*keys, "_salt"], "left").drop("_salt")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Median per group without holding a group's values in one task.

    Equal values are counted before the shuffle. The counts are sorted across
    partitions once; the sums per partition tell which partition of a group
    holds a middle rank, and only those are ranked, each in its own task. So no
    task sees more than one sorted partition, whatever the values look like.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_m"))
    stored = materialise(counted.orderBy(*keys, "_v").withColumn("_part", F.spark_partition_id()), "median-values")
    # One row per group and partition.
    parts = stored.groupBy(*keys, "_part").agg(F.sum("_m").alias("_s"))
    whole, running = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_part")
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    picked = materialise(
        parts.withColumns({"_n": F.sum("_s").over(whole), "_end": F.sum("_s").over(running)})
        .withColumn("_before", F.col("_end") - F.col("_s"))
        .filter((F.col("_before") <= high) & (F.col("_end") > low))
        .select(*keys, "_part", "_n", "_before"), "median-parts",
    )
    within = Window.partitionBy(*keys, "_part").orderBy("_v")
    same = functools.reduce(operator.and_, [stored[k].eqNullSafe(picked[k]) for k in keys] + [stored["_part"] == picked["_part"]])
    ranked = (
        stored.join(picked, same).select(*[stored[k] for k in keys], stored["_part"], "_v", "_m", "_n", "_before")
        .withColumn("_end", F.col("_before") + F.sum("_m").over(within))
        .withColumn("_start", F.col("_end") - F.col("_m"))
    )
    at = lambda rank: F.max(F.when((F.col("_start") <= rank) & (F.col("_end") > rank), F.col("_v")))
    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(out))
