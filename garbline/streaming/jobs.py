"""Streaming transformations. Each takes and returns a DataFrame, so a batch run is its own twin.

Keyed aggregates combine on the map side before the shuffle, so a hot key reaches its
state as one row per task and batch. Rows are dealt out before that: a batch may arrive as one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from garbline.operators.status_jobs import final_status, status_aggregates
from garbline.streaming.keyed import KeyedTable, keyed_copy


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` spread over all tasks by a hash of the row.

    A file that arrives whole is read by one task or a few; combined there, all keys of the batch would meet in
    their memory.
    """
    return rows.repartition(*rows.columns)


def status_stream(commands: DataFrame, period: str = "7 days") -> DataFrame:
    """What the commands of each period say about an order (update mode); see ``current_status``.

    The latest commands of a period are all that later ones need, so an order's state leaves when the
    watermark passes the period's end, and what it said stays in the table. State is bounded by
    the orders that have commands within a period and the watermark's delay, however long the stream runs.
    """
    folded = dealt(commands).groupBy(F.window("ts", period).alias("w"), "order_id").agg(*status_aggregates())
    return folded.select("order_id", F.col("w.start").alias("period"), "last_set", "last_cancel")


def current_status(said: DataFrame) -> DataFrame:
    """Status per order from the periods or the change log of ``status_stream``: later entries only add."""
    latest = said.groupBy("order_id").agg(F.max("last_set").alias("last_set"), F.max("last_cancel").alias("last_cancel"))
    return latest.select("order_id", final_status().alias("status"))


def stock_stream(movements: DataFrame) -> DataFrame:
    """Net movement and number of movements per SKU (update mode)."""
    return dealt(movements).groupBy("sku").agg(
        F.sum("delta").cast("bigint").alias("net"), F.count("*").alias("movements")
    )


def spend_stream(spend: DataFrame) -> DataFrame:
    """Spend per user and day, with the month for roll-ups. Days behind the watermark are closed."""
    daily = dealt(spend).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(
        F.sum("amount").alias("amount"), F.count("*").alias("purchases")
    )
    start = F.col("w.start")
    return daily.select(
        "user_id",
        start.alias("day"),
        F.date_trunc("month", start).alias("month"),
        F.col("amount").cast("double").alias("amount"),
        "purchases",
    )


def engagement_stream(marks: DataFrame, length: str = "6 hours", slide: str = "1 hour") -> DataFrame:
    """Likes, reads and comments per post in sliding windows."""
    counted = dealt(marks).groupBy(F.window("ts", length, slide).alias("w"), "post_id", "kind").agg(
        F.count("*").alias("marks")
    )
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "post_id", "kind", "marks"
    )


def read_marks_table(spark: SparkSession, root: str | None = None) -> KeyedTable:
    """Read marks, one per post and user."""
    schema = StructType().add("post_id", "long").add("user_id", "long")
    return KeyedTable(spark, ["post_id", "user_id"], schema, root)


OUTBOX_SCHEMA = "event_id BIGINT, order_id BIGINT, kind STRING, audience STRING, recipient_id BIGINT, recipient STRING"


def audience_members(users: DataFrame, role: str = "packer") -> DataFrame:
    """Who a notice to an audience reaches: one row per user of the role."""
    return users.where(F.col("system_role") == role).select(
        F.lit(role).alias("audience"), F.col("id").alias("recipient_id"), F.col("email").alias("recipient")
    )


def outbox_sides(carts: DataFrame, users: DataFrame) -> tuple[KeyedTable, KeyedTable]:
    """Carts and users as the outbox looks them up, written once."""
    owners = carts.select(F.col("id").alias("order_id"), F.col("supervisor_id").alias("recipient_id"))
    contacts = users.select(F.col("id").alias("recipient_id"), F.col("email").alias("recipient"))
    return keyed_copy(owners, ["order_id"]), keyed_copy(contacts, ["recipient_id"])


def outbox(commands: DataFrame, carts: KeyedTable, users: KeyedTable) -> DataFrame:
    """Notices due for a batch of status commands: the packers on submit, the owner on pack and complete.

    A submitted order is one notice to the audience ``packer``, whose members are
    ``audience_members``, so the outbox grows with the orders alone. ``carts`` (order_id, recipient_id)
    and ``users`` (recipient_id, recipient) are read in the buckets that the batch's orders, and
    then their owners, fall into.
    """
    nobody = [F.lit(None).cast("bigint").alias("recipient_id"), F.lit(None).cast("string").alias("recipient")]
    to_packers = commands.where(F.col("command") == "submitted").select(
        "event_id", "order_id", F.lit("new order").alias("kind"), F.lit("packer").alias("audience"), *nobody
    )
    due = commands.where(F.col("command").isin("packed", "completed"))
    owned = due.join(carts.near(due), "order_id")
    contacts = users.near(owned)
    to_owners = owned.join(contacts, "recipient_id").select(
        "event_id", "order_id", F.col("command").alias("kind"), F.lit(None).cast("string").alias("audience"),
        "recipient_id", "recipient",
    )
    return to_packers.unionByName(to_owners)
