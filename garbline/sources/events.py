"""The event stream: order commands, stock movements, spend and engagement in one event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garbline.schemas import EVENTS_DDL, MONEY
from garbline.session import configure, scratch_path

# Which event stands for which status command, movement and engagement.
COMMAND_OF_EVENT = {
    "signup": "created",
    "click": "submitted",
    "view": "packed",
    "purchase": "completed",
    "error": "cancelled",
}
ENGAGEMENT_OF_EVENT = {"click": "like", "view": "read", "purchase": "comment"}


def _mapped(mapping: dict[str, str]) -> Column:
    chain = None
    for event, value in mapping.items():
        hit = F.col("event_type") == event
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def read_events(
    spark: SparkSession, path: str, watermark: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Stream the event files under ``path``; event time is a TIMESTAMP, as watermarks need it.

    ``files_per_batch`` bounds a micro-batch, so a backlog is worked off in steps.
    """
    reader = configure(spark).readStream.schema(EVENTS_DDL)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    events = reader.parquet(f"{path}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return events if watermark is None else events.withWatermark("ts", watermark)


def staged_arrivals(events: DataFrame, files: int) -> str:
    """Write ``events`` as so many files in order of time, one after the other; returns their folder.

    A table that lies there whole becomes what a stream meets: files that arrive in turn.
    """
    spark = events.sparkSession
    path = scratch_path(spark, "arrivals")
    moment = F.col("ts").cast("timestamp").cast("double")
    cuts = events.select(moment.alias("at")).approxQuantile("at", [i / files for i in range(1, files)], 0.05)
    for i in range(files):
        kept = F.lit(True)
        if i:
            kept = kept & (moment >= cuts[i - 1])
        if i < len(cuts):
            kept = kept & (moment < cuts[i])
        events.where(kept if i else kept | F.col("ts").isNull()).coalesce(1).write.parquet(f"{path}/events{i}.parquet")
    return path


def command() -> Column:
    """The status command an event stands for."""
    return _mapped(COMMAND_OF_EVENT)


def status_commands(events: DataFrame) -> DataFrame:
    """order_id, ts, event_id, command."""
    return events.select(
        F.col("user_id").alias("order_id"), "ts", "event_id", command().alias("command")
    )


def stock_movements(events: DataFrame, n_skus: Column) -> DataFrame:
    """sku, ts, event_id, delta: issue takes one, receipt and return add one, a lost garment adds none.

    An event concerns one of the ``n_skus`` SKUs, by its number.
    """
    kind = F.col("event_type")
    delta = F.when(kind == "purchase", -1).when(kind == "signup", 1).when(
        kind == "error", F.when(F.col("event_id") % 3 == 0, 0).otherwise(1)
    )
    moved = events.select((F.col("event_id") % n_skus).alias("sku"), "ts", "event_id", delta.alias("delta"))
    return moved.where(F.col("delta").isNotNull())


def spend_events(events: DataFrame) -> DataFrame:
    """user_id, ts, event_id, amount."""
    bought = events.where(F.col("event_type") == "purchase")
    return bought.select("user_id", "ts", "event_id", F.col("value").cast(MONEY).alias("amount"))


def post_of_event(n_posts: Column) -> Column:
    """The post an event is about: every user comes back to three posts."""
    return (F.col("user_id") * 13 + F.col("event_id") % 3) % n_posts


def engagement_events(events: DataFrame, n_posts: Column) -> DataFrame:
    """post_id, kind (like, read, comment), user_id, ts, event_id."""
    rows = events.select(
        post_of_event(n_posts).alias("post_id"), _mapped(ENGAGEMENT_OF_EVENT).alias("kind"), "user_id", "ts",
        "event_id",
    )
    return rows.where(F.col("kind").isNotNull())
