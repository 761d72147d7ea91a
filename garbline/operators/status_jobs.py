"""Order status changes, garment issue and garment returns, over batches of commands."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garbline.functions.dates import ntz
from garbline.schemas import CANCEL_REFUSED, RETURNED_PREFIX


def status_aggregates() -> list[Column]:
    """Latest status-setting command and latest cancel of an order, both by (ts, event_id)."""
    is_cancel = F.col("command") == "cancelled"
    return [
        F.max(F.when(~is_cancel, F.struct("ts", "event_id", "command"))).alias("last_set"),
        F.max(F.when(is_cancel, F.struct("ts", "event_id"))).alias("last_cancel"),
    ]


def final_status(base: Column | None = None) -> Column:
    """The status after all commands.

    Pack and complete have no guard. A cancel counts if it came after the latest other
    status and that status allows it; ``base`` is the status before the first command.
    """
    current = F.col("last_set.command")
    if base is not None:
        current = F.coalesce(current, base)
    later = F.col("last_cancel").isNotNull() & (
        F.col("last_set").isNull() | (F.col("last_cancel") > F.struct("last_set.ts", "last_set.event_id"))
    )
    refused = F.coalesce(current.isin(*CANCEL_REFUSED), F.lit(False))
    return F.when(later & ~refused, "cancelled").otherwise(current)


def apply_status(carts: DataFrame, commands: DataFrame) -> DataFrame:
    """Carts with their status after ``commands`` (order_id, ts, event_id, command)."""
    folded = commands.groupBy(F.col("order_id").alias("id")).agg(*status_aggregates())
    return (
        carts.join(folded, "id", "left")
        .withColumn("status", final_status(F.col("status")))
        .drop("last_set", "last_cancel")
    )


def issue_garments(
    items: DataFrame, completed: DataFrame, as_of: dt.datetime, mode: str = "per_line"
) -> DataFrame:
    """Garments for the lines of completed orders (``cart_id``).

    One active garment per line whatever its quantity; ``per_unit`` issues one per unit.
    """
    lines = items.join(completed.select("cart_id"), "cart_id", "left_semi")
    if mode == "per_unit":
        lines = lines.where(F.col("quantity") > 0).withColumn("_unit", F.explode(F.sequence(F.lit(1), "quantity")))
    elif mode != "per_line":
        raise ValueError(f"unknown mode {mode!r}")
    return lines.select(
        "cart_id",
        "product_size_id",
        "team_member_id",
        F.lit("active").alias("status"),
        ntz(as_of).alias("issued_at"),
        F.lit(None).cast("timestamp_ntz").alias("returned_at"),
    )


def restocks(path: str) -> Column:
    """Whether a return puts the garment back in stock: ``self`` or ``worker`` path."""
    if path == "self":
        return F.col("reason") != "lost"
    if path == "worker":
        return ~F.col("reason").isin("lost", "stolen")
    raise ValueError(f"unknown path {path!r}")


def restock(skus: DataFrame, returns: DataFrame) -> DataFrame:
    """SKUs with stock raised by one per return that restocks.

    ``returns``: product_size_id, reason, path. Returns are not guarded: repeated ones count again.
    """
    counts = F.when(F.col("path") == "worker", restocks("worker")).otherwise(restocks("self"))
    back = (
        returns.where(counts)
        .groupBy(F.col("product_size_id").alias("id"))
        .agg(F.count("*").alias("_back"))
    )
    return skus.join(back, "id", "left").withColumn(
        "stock", (F.col("stock") + F.coalesce("_back", F.lit(0))).cast("bigint")
    ).drop("_back")


def apply_returns(
    garments: DataFrame, skus: DataFrame, returns: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(garments, skus) after ``returns``: seq, garment_id, reason, path, at.

    The latest return of a garment, of equally late ones that with the largest ``seq``,
    sets its status and time; each one counts for stock.
    """
    known = returns.join(
        garments.select(F.col("id").alias("garment_id"), "product_size_id"), "garment_id"
    )
    last = returns.groupBy(F.col("garment_id").alias("id")).agg(
        F.max(F.struct("at", "seq", "reason")).alias("_last")
    ).select("id", F.col("_last.at").alias("_at"), F.col("_last.reason").alias("_reason"))
    done = F.col("_reason").isNotNull()
    updated = garments.join(last, "id", "left").withColumns(
        {
            "status": F.when(done, F.concat(F.lit(RETURNED_PREFIX), "_reason")).otherwise(F.col("status")),
            "returned_at": F.when(done, F.col("_at")).otherwise(F.col("returned_at")),
        }
    )
    return updated.select(*garments.columns), restock(skus, known)


def request_replacement(garments: DataFrame, ids: DataFrame) -> DataFrame:
    """Garments whose replacement was asked for (``garment_id``) become lost; stock is untouched."""
    asked = ids.select(F.col("garment_id").alias("id"), F.lit(True).alias("_asked")).distinct()
    return garments.join(asked, "id", "left").withColumn(
        "status", F.when(F.col("_asked"), "lost").otherwise(F.col("status"))
    ).drop("_asked")
