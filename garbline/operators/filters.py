"""Row filters, classifications and predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garbline.functions.bands import band
from garbline.functions.dates import covers, day, ntz
from garbline.functions.text import contains_text, return_reason
from garbline.schemas import (
    AUDIENCE_ALL,
    CANCEL_OFFERED,
    CANCEL_REFUSED,
    HIGHLIGHT_CUTS,
    LOW_STOCK,
    ROLE_EVERYONE,
    ROLE_PACKER,
    STOCK_CUTS,
)


def visible_orders(carts: DataFrame, viewer_id: int, role: str, supervisor: int | None = None) -> DataFrame:
    """Supervisors see their own orders; only admins may narrow by supervisor; others see all."""
    if role == "supervisor":
        return carts.where(F.col("supervisor_id") == viewer_id)
    if role == "admin" and supervisor is not None:
        return carts.where(F.col("supervisor_id") == supervisor)
    return carts


def visible_order_counts(carts: DataFrame, users: DataFrame) -> DataFrame:
    """What every user can see: number and value of visible orders, by the same rule."""
    own = carts.groupBy("supervisor_id").agg(
        F.count("*").alias("orders"), F.sum("total_price").alias("value")
    )
    scoped = own.select(F.col("supervisor_id").alias("scope"), "orders", "value")
    everything = own.agg(F.sum("orders").alias("orders"), F.sum("value").alias("value"))
    supervisors = users.where(F.col("system_role") == "supervisor").join(
        scoped, users["id"] == scoped["scope"], "left"
    )
    others = (
        users.where(F.col("system_role") != "supervisor")
        .withColumn("orders", everything.select("orders").scalar())
        .withColumn("value", everything.select("value").scalar())
    )
    columns = [
        F.col("id").alias("viewer_id"),
        "system_role",
        F.coalesce("orders", F.lit(0)).cast("bigint").alias("visible_orders"),
        F.coalesce("value", F.lit(0)).cast("double").alias("visible_value"),
    ]
    return supervisors.select(*columns).unionByName(others.select(*columns))


def filter_orders(
    carts: DataFrame,
    status: str | None = None,
    start: dt.date | dt.datetime | str | None = None,
    end: dt.date | dt.datetime | str | None = None,
    supervisor: int | None = None,
    hide_sent: bool = True,
) -> DataFrame:
    """The order-list filter. A bare end date is its midnight, so later times drop out."""
    wanted = []
    if supervisor is not None:
        wanted.append(F.col("supervisor_id") == supervisor)
    if status:
        wanted.append(F.col("status") == status)
    elif hide_sent:
        wanted.append(F.col("status") != "completed")
    if start is not None:
        wanted.append(F.col("created_at") >= ntz(start))
    if end is not None:
        wanted.append(F.col("created_at") <= ntz(end))
    for condition in wanted:
        carts = carts.where(condition)
    return carts


def search_products(products: DataFrame, text: str | None) -> DataFrame:
    """Literal, case-insensitive search in name or article number."""
    text = (text or "").strip()
    if not text:
        return products
    return products.where(
        contains_text(F.col("name"), text) | contains_text(F.col("article_number"), text)
    )


def _sku_rows(skus: DataFrame, products: DataFrame) -> DataFrame:
    names = products.select(F.col("id").alias("product_id"), "name", "article_number")
    return skus.select(F.col("id").alias("sku_id"), "product_id", "size", "stock").join(names, "product_id")


def low_stock(
    skus: DataFrame,
    products: DataFrame,
    threshold: int = LOW_STOCK,
    include_zero: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """SKUs at or below the threshold, scarcest first; the dashboard form leaves out empty ones."""
    short = skus.where(F.col("stock") <= threshold)
    if not include_zero:
        short = short.where(F.col("stock") > 0)
    rows = _sku_rows(short, products).select("sku_id", "name", "size", "stock").orderBy("stock", "sku_id")
    return rows.limit(limit) if limit is not None else rows


def low_stock_count(skus: DataFrame, threshold: int = LOW_STOCK) -> DataFrame:
    return skus.where(F.col("stock") <= threshold).agg(F.count("*").alias("low_stock"))


def stock_bands(skus: DataFrame, products: DataFrame) -> DataFrame:
    """Every SKU with its stock band and the catalogue highlight."""
    return _sku_rows(skus, products).select(
        "sku_id",
        "name",
        "article_number",
        "size",
        "stock",
        band(F.col("stock"), *STOCK_CUTS).alias("stock_band"),
        band(F.col("stock"), *HIGHLIGHT_CUTS).alias("highlight"),
    )


def garment_state(df: DataFrame, rule: str, status: str = "status") -> DataFrame:
    """Add ``returned`` and ``return_reason``.

    Rule ``team``: everything but active is returned, an empty status too. Rule
    ``history``: active, issued and empty are not returned.
    """
    state = F.coalesce(F.col(status), F.lit(""))
    if rule == "team":
        returned = state != "active"
    elif rule == "history":
        returned = ~state.isin("active", "issued", "")
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return df.withColumn("returned", returned).withColumn("return_reason", return_reason(state))


def returnable(garments: DataFrame) -> DataFrame:
    """Garments that still offer a return button."""
    return garment_state(garments, "team").where(~F.col("returned")).drop("returned", "return_reason")


def active_delegations(delegations: DataFrame, as_of: dt.date) -> DataFrame:
    return delegations.where(covers(F.col("start_date"), F.col("end_date"), as_of))


def delegation_flag(as_of: dt.date) -> Column:
    """The flag looks at the end date only, so a future delegation shows Active."""
    return F.when(F.col("end_date") >= day(as_of), "Active").otherwise("Expired")


def directory(users: DataFrame, role: str, exclude_id: int | None = None) -> DataFrame:
    people = users.where(F.col("system_role") == role)
    if exclude_id is not None:
        people = people.where(F.col("id") != exclude_id)
    return people.select("id", "full_name", "email").orderBy("full_name", "id")


def assignable_roles(roles: DataFrame, excluded: tuple[str, ...] = (ROLE_EVERYONE, ROLE_PACKER)) -> DataFrame:
    return roles.where(~F.col("name").isin(*excluded))


def audience(posts: DataFrame, role: str) -> DataFrame:
    return posts.where(F.col("target_role").isin(AUDIENCE_ALL, role))


def may_cancel(rule: str) -> Column:
    """``list``: the button is shown. ``handler``: the command is accepted."""
    if rule == "list":
        return F.col("status").isin(*CANCEL_OFFERED)
    if rule == "handler":
        return ~F.col("status").isin(*CANCEL_REFUSED)
    raise ValueError(f"unknown rule {rule!r}")


def cancellable(carts: DataFrame, viewer: int, role: str, rule: str) -> DataFrame:
    """Orders the viewer may cancel. Packers get no button, but no refusal either."""
    if rule == "list" and role not in ("admin", "supervisor"):
        return carts.where(F.lit(False))
    allowed = carts.where(may_cancel(rule))
    return allowed.where(F.col("supervisor_id") == viewer) if role == "supervisor" else allowed


def out_of_stock_products(products: DataFrame, skus: DataFrame) -> DataFrame:
    """Products that have sizes, none of which has stock; with their orderable-size count."""
    state = skus.groupBy("product_id").agg(
        F.count("*").alias("sizes"),
        F.count_if(F.col("stock") != 0).alias("orderable_sizes"),
        F.bool_or(F.col("stock") > 0).alias("in_stock"),
    )
    gone = state.where(~F.col("in_stock"))
    return products.join(gone, products["id"] == gone["product_id"]).select(
        "product_id", "name", "sizes", "orderable_sizes"
    )


def orderable_skus(skus: DataFrame) -> DataFrame:
    """A size can be chosen unless its stock is exactly zero."""
    return skus.where(F.col("stock") != 0)


def workers_of(team: DataFrame, supervisors: list[int] | DataFrame | None = None) -> DataFrame:
    """Workers of the given supervisors (ids, or a DataFrame with ``supervisor_id``), or all."""
    if isinstance(supervisors, DataFrame):
        team = team.join(supervisors.select("supervisor_id").distinct(), "supervisor_id", "left_semi")
    elif supervisors is not None:
        team = team.where(F.col("supervisor_id").isin(*supervisors))
    return team.select("id", "full_name", "employee_number", "supervisor_id").orderBy("full_name", "id")
