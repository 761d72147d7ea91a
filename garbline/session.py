"""Session settings the operators rely on, and shared-storage helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Runtime settings only: nothing here needs a new session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Broadcasts are decided by size estimates; Parquet files are several times smaller than
    # the rows in memory, so estimate with that factor.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    # Rows with whole texts go to Python in small batches.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    # Keyed stream state lives on disk and in the shared checkpoint, not on the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark`` and return it."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    # A cluster whose shuffles were never sized would run every one with 200 partitions. Many small
    # ones to begin with cost little: adaptive execution merges them.
    if spark.conf.get("spark.sql.shuffle.partitions") == "200":
        first = str(max(200, 3 * spark.sparkContext.defaultParallelism))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", first)
    return spark


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark; ``shared`` is its folder for intermediate tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("garbline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, as ``spark.checkpoint.dir`` names it.

    Where the session names none, a folder under the warehouse serves: the warehouse too is
    shared by the driver and the executors. No machine-local temporary folder is ever used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/garbline_scratch").rstrip("/")


# Scratch paths handed out by this process, newest last, until ``clear_scratch`` removes them.
_OWN: list[str] = []


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _OWN.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path of this process through the file system that Spark uses for it."""
    if path in _OWN:
        _OWN.remove(path)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_mark() -> int:
    """A point in time, for ``discard_since``."""
    return len(_OWN)


def scratch_since(mark: int) -> list[str]:
    """The scratch paths made since ``mark``, the newest last."""
    return _OWN[mark:]


def discard_since(spark: SparkSession, mark: int, keep: int = 1) -> None:
    """Delete the scratch paths made since ``mark`` but for the ``keep`` newest.

    For a job that has written out all that its result reads: no lineage leads back to the
    deleted tables.
    """
    for path in _OWN[mark : len(_OWN) - keep]:
        remove_path(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch path of this process. For the owner of a finished job."""
    for path in list(_OWN):
        remove_path(spark, path)


def cut_and_count(df: DataFrame, kind: str = "cut") -> tuple[DataFrame, int]:
    """``cut_lineage`` with the number of rows, counted while they are written."""
    seen = Observation()
    cut = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n")), kind)
    return cut, seen.get["n"]


def cut_lineage(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and continue from there.

    Columns without a type of their own (all NULL) are written as strings.
    """
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    void = {name: df[name].cast("string") for name, kind_ in df.dtypes if kind_ == "void"}
    (df.withColumns(void) if void else df).write.parquet(path)
    return spark.read.schema(df.withColumns(void).schema if void else df.schema).parquet(path)
