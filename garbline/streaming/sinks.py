"""Run streaming jobs to the end of the available input, into tables in the shared folder.

Every batch writes its own directory in overwrite mode, so a batch that is run again
after a failure replaces its first attempt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.session import scratch_path
from garbline.streaming.keyed import KeyedTable


def append_to_table(stream: DataFrame, root: str | None = None) -> DataFrame:
    """Append-mode job into a Parquet file sink; returns the written table."""
    spark = stream.sparkSession
    root = root or scratch_path(spark, "stream")
    job = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def changes_to_table(stream: DataFrame, root: str | None = None, progress: list | None = None) -> DataFrame:
    """Update-mode job into a change log with the column ``batch``; returns the log.

    ``progress`` collects Spark's report on each batch.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, "stream")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/changes/batch={batch}")

    job = (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    if progress is not None:
        progress += job.recentProgress
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{fields}, batch BIGINT").parquet(f"{root}/changes")


def batches_to_table(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], schema: str, root: str | None = None
) -> DataFrame:
    """Append-only job that runs a batch function on every micro-batch; returns the written table."""
    spark = stream.sparkSession
    root = root or scratch_path(spark, "stream")

    def write(rows: DataFrame, batch: int) -> None:
        # a transform may read its batch several times
        held = rows.persist()
        try:
            transform(held).write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")
        finally:
            held.unpersist()

    job = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.schema(f"{schema}, batch BIGINT").parquet(f"{root}/rows").drop("batch")


def absent_to_table(stream: DataFrame, table: KeyedTable, root: str | None = None) -> DataFrame:
    """Insert rows whose keys ``table`` does not have, batch by batch; returns the table's rows.

    The table itself is the memory: no state is kept in the stream, so rows that repeat are
    found at any distance in time, and a batch that is run again writes the same rows.
    """
    root = root or scratch_path(stream.sparkSession, "stream")
    job = (
        stream.writeStream.foreachBatch(table.insert_absent)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return table.read()


def latest_rows(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The current row of each key of a change log.

    A key comes once in a batch, so files hold little to combine. Rows are dealt by key first, and a task sorts
    what a shuffle partition holds instead of what a file split does.
    """
    values = [c for c in changes.columns if c not in (*keys, "batch")]
    last = changes.repartition(*keys).groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "_last.*")
