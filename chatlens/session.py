"""Session set-up and the shared working folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import chatlens

# Functions of this package travel with the job, so workers need no installed copy.
cloudpickle.register_pickle_by_value(chatlens)

_LOCAL_FOLDER = "chatlens.local.folder"
_SCOPE = "chatlens.scope.folder"


def build_session(master: str = "local[*]", app: str = "chatlens", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session may run without the setting: it then gets a
    temporary folder, noted in the session so that later calls agree.
    """
    context = spark.sparkContext
    configured = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
        or spark.conf.get(_LOCAL_FOLDER, None)
    )
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="chatlens-")
    spark.conf.set(_LOCAL_FOLDER, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, or below the folder of the present scope."""
    folder = spark.conf.get(_SCOPE, None) or f"{shared_dir(spark)}/chatlens"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def remove_stored(spark: SparkSession, path: str) -> None:
    """Delete a table or folder that this package has written."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether a table or folder is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


@contextlib.contextmanager
def stored_tables(spark: SparkSession) -> Iterator[str]:
    """Give the tables stored inside the block an end: they are deleted when it is left.

    Results must be written or collected inside the block. Only the block's own
    folder is removed, never the shared folder or what others have put there.
    """
    folder = f"{shared_dir(spark)}/chatlens/scope-{uuid.uuid4().hex}"
    outer = spark.conf.get(_SCOPE, None)
    spark.conf.set(_SCOPE, folder)
    try:
        yield folder
    finally:
        spark.conf.set(_SCOPE, outer) if outer else spark.conf.unset(_SCOPE)
        remove_stored(spark, folder)


def finished(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` describes, stored; whatever ``build`` has stored on the way is deleted."""
    path = scratch_path(spark, name)
    with stored_tables(spark):
        result = build()
        result.write.parquet(path)
    return spark.read.schema(result.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy text stages at least one partition per core.

    Few large files, or files with one row group, leave most cores idle. A
    table that already has several partitions per core is left as it is, so
    large inputs are never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Used where a result feeds several consumers and must not be computed twice
    (model output, loop state), and where the lineage has to be cut. The table
    survives the loss of executors. Its file size is known to the optimizer, so
    a join broadcasts it only if it is really below the broadcast threshold.
    ``compression`` is a codec of Parquet for tables of long texts; without it the session's holds.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
