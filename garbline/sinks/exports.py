"""Flat exports and the printed order report, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.functions.text import dash_if_empty, money_text
from garbline.operators.filters import filter_orders, visible_orders
from garbline.operators.joins import wide_order_lines

FORMATS = ["parquet", "csv", "json", "orc"]


def _orders(t, viewer: int | None, role: str, **filters) -> DataFrame:
    """Exports keep completed orders; the row-visibility rule applies as in the list."""
    supervisor = filters.pop("supervisor", None)
    shown = visible_orders(t.order_carts, viewer, role, supervisor)
    return filter_orders(shown, hide_sent=False, **filters)


def order_lines_export(t, viewer: int | None = None, role: str = "admin", **filters) -> DataFrame:
    """The 13-column order-line export. NULLs stay NULL; they are not turned into text."""
    lines = wide_order_lines(t, _orders(t, viewer, role, **filters))
    money = ["total_price", "price_at_time", "subtotal"]
    return lines.withColumns({c: F.col(c).cast("double") for c in money})


def order_report(t, viewer: int | None = None, role: str = "admin", **filters) -> DataFrame:
    """The printed report's text columns."""
    lines = wide_order_lines(t, _orders(t, viewer, role, **filters))
    return lines.select(
        F.col("order_id").cast("string").alias("order_id"),
        "status",
        F.date_format("created_at", "yyyy-MM-dd").alias("date"),
        "supervisor",
        "product",
        "size",
        F.col("quantity").cast("string").alias("qty"),
        money_text(F.col("price_at_time")).alias("price"),
        dash_if_empty(F.col("worker")).alias("worker"),
    )


def order_summary_export(t) -> DataFrame:
    """One row per order with its owner."""
    owners = t.users.select(F.col("id").alias("supervisor_id"), "full_name")
    return t.order_carts.join(owners, "supervisor_id").select(
        "id", "full_name", F.col("total_price").cast("double").alias("total_price"), "status", "created_at"
    )


def write_export(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    """Write an export in parallel; ``partition_by`` lays it out by that column (e.g. order month)."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.mode("overwrite")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
