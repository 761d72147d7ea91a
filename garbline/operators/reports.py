"""Aggregated reports, rankings and latest-per-group lists.

Facts are summed by their own key before they meet any other table, so a hot key is
reduced on the map side and no join carries unaggregated rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garbline.functions.bands import band
from garbline.functions.dates import in_month, ntz
from garbline.functions.spread import join_spread_nulls, number_rows
from garbline.operators.joins import acting_pairs, worker_names
from garbline.operators.filters import active_delegations, garment_state
from garbline.schemas import (
    ACTIVE_STATUSES,
    BUDGET_CUTS,
    DAYS_CUTS,
    LOW_STOCK,
    PENDING_STATUSES,
    PRODUCT_TYPES,
    RETURN_BUTTONS,
    SPENT_STATUSES,
    STOCK_CUTS,
)



def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def month_usage(carts: DataFrame, as_of: dt.date) -> DataFrame:
    """Spent per supervisor in the month of ``as_of`` (DECIMAL); supervisors without spend are absent."""
    spent = carts.where(F.col("status").isin(*SPENT_STATUSES) & in_month(F.col("created_at"), as_of))
    return spent.groupBy("supervisor_id").agg(F.sum("total_price").alias("used"))


def budget_usage(carts: DataFrame, users: DataFrame, as_of: dt.date) -> DataFrame:
    """Month usage of every supervisor, 0 when there is none."""
    bosses = users.where(F.col("system_role") == "supervisor").select(F.col("id").alias("supervisor_id"))
    return bosses.join(month_usage(carts, as_of), "supervisor_id", "left").select(
        "supervisor_id", _zero("used").cast("double").alias("used")
    )


def open_cart_units(items: DataFrame, carts: DataFrame, by: str) -> DataFrame:
    """Units in open carts per ``supervisor_id`` or per ``team_member_id``."""
    open_carts = carts.where(F.col("status") == "created").select(F.col("id").alias("cart_id"), "supervisor_id")
    if by == "supervisor_id":
        per_cart = items.groupBy("cart_id").agg(F.sum("quantity").alias("q"))
        rows = per_cart.join(open_carts, "cart_id")
    elif by == "team_member_id":
        rows = items.where(F.col("team_member_id").isNotNull()).groupBy("team_member_id", "cart_id").agg(
            F.sum("quantity").alias("q")
        ).join(open_carts, "cart_id", "left_semi")
    else:
        raise ValueError(f"unknown grouping {by!r}")
    return rows.groupBy(by).agg(F.sum("q").cast("bigint").alias("units"))


def order_workers(t, carts: DataFrame | None = None) -> DataFrame:
    """(cart_id, worker_id, name): every worker on the lines of the orders, or of the given ``cart_id``s, once."""
    lines = t.order_items.where(F.col("team_member_id").isNotNull()).select(
        "cart_id", F.col("team_member_id").alias("worker_id")
    )
    if carts is not None:
        lines = lines.join(carts.select("cart_id"), "cart_id", "left_semi")
    names = worker_names(t.team_members).select("worker_id", F.col("worker_name").alias("name"))
    return lines.distinct().join(names, "worker_id").select("cart_id", "worker_id", "name")


def order_list(t, carts: DataFrame | None = None) -> DataFrame:
    """The order list: owner, worker, employee number, number of lines and of workers on them.

    The worker is the order's own, else the first by name on its lines; ``order_workers`` lists
    all. Lines are counted per order and worker before any join, so the columns are the
    same however many workers an order has.
    """
    carts = t.order_carts if carts is None else carts
    owners = t.users.select(F.col("id").alias("supervisor_id"), F.col("full_name").alias("supervisor_name"))
    headed = join_spread_nulls(
        carts.join(owners, "supervisor_id"), worker_names(t.team_members), "team_member_id", "worker_id", ["id"]
    ).select(
        F.col("id").alias("cart_id"), "status", "created_at", "total_price", "supervisor_name", "worker_name",
        "employee_number",
    )
    counts = t.order_items.groupBy("cart_id", "team_member_id").agg(F.count("*").alias("n"))
    names = worker_names(t.team_members).select("worker_id", F.col("worker_name").alias("name"))
    lines = (
        join_spread_nulls(counts, names, "team_member_id", "worker_id")
        .groupBy("cart_id")
        .agg(
            F.sum("n").alias("item_count"), F.min("name").alias("line_worker"),
            F.count("worker_id").alias("worker_count"),
        )
    )
    return headed.join(lines, "cart_id", "left").select(
        F.col("cart_id").alias("id"),
        "status",
        "created_at",
        F.col("total_price").cast("double").alias("total_price"),
        "supervisor_name",
        F.coalesce("worker_name", "line_worker").alias("worker_name"),
        "employee_number",
        _zero("item_count").cast("bigint").alias("item_count"),
        _zero("worker_count").cast("bigint").alias("worker_count"),
    )


# Fixed sort keys of the order list.
ORDER_SORTS = {
    "id": "id",
    "worker": "worker_name",
    "supervisor": "supervisor_name",
    "total": "total_price",
    "date": "created_at",
    "status": "status",
}


def sort_orders(orders: DataFrame, sort: str = "date", direction: str = "desc") -> DataFrame:
    """Sort the order list by a listed key; anything else falls back to newest first."""
    column = F.col(ORDER_SORTS.get(sort, "created_at"))
    if direction == "asc" and sort in ORDER_SORTS:
        return orders.orderBy(column.asc(), F.col("id").asc())
    return orders.orderBy(column.desc(), F.col("id").desc())


def size_columns(sizes: DataFrame) -> DataFrame:
    """One row per worker with a column per product type."""
    names = {"SHIRT": "shirt_size", "PANTS": "pants_size", "SHOES": "shoe_size"}
    return sizes.groupBy("team_member_id").agg(
        *[F.max(F.when(F.col("product_type") == p, F.col("size"))).alias(names[p]) for p in PRODUCT_TYPES]
    )


def _team_with_sizes(team: DataFrame, roles: DataFrame, sizes: DataFrame) -> DataFrame:
    role_names = roles.select(F.col("id").alias("job_role_id"), F.col("name").alias("role_name"))
    worn = size_columns(sizes).withColumnRenamed("team_member_id", "id")
    return team.join(role_names, "job_role_id", "left").join(worn, "id", "left").select(
        "id", "supervisor_id", "full_name", "employee_number", "role_name", "shirt_size", "pants_size", "shoe_size"
    )


def team_sizes(team: DataFrame, roles: DataFrame, sizes: DataFrame, supervisor: int | None = None) -> DataFrame:
    """Team roster with sizes as columns, by name."""
    if supervisor is not None:
        team = team.where(F.col("supervisor_id") == supervisor)
    return _team_with_sizes(team, roles, sizes).orderBy("full_name", "id")


def delegated_team_sizes(t, as_of: dt.date, supervisor: int | None = None) -> DataFrame:
    """The rosters of teams delegated on the day, per delegation and owner."""
    live = active_delegations(t.supervisor_delegations, as_of)
    if supervisor is not None:
        live = live.where(F.col("to_supervisor_id") == supervisor)
    owners = t.users.select(F.col("id").alias("supervisor_id"), F.col("full_name").alias("supervisor_name"))
    links = live.select(
        F.col("id").alias("delegation_id"), "to_supervisor_id", F.col("from_supervisor_id").alias("supervisor_id")
    )
    roster = _team_with_sizes(t.team_members, t.job_roles, t.worker_sizes)
    rows = roster.join(links, "supervisor_id").join(owners, "supervisor_id").drop("supervisor_id")
    return rows.orderBy("supervisor_name", "full_name", "id")


def team_size(team: DataFrame) -> DataFrame:
    return team.groupBy("supervisor_id").agg(F.count("*").alias("team_size"))


def delegated_team_size(team: DataFrame, delegations: DataFrame, as_of: dt.date) -> DataFrame:
    """Members per delegated group: how many workers each acting supervisor covers for each owner."""
    sizes = team_size(team).withColumnRenamed("supervisor_id", "owner_id")
    return acting_pairs(delegations, as_of).join(sizes, "owner_id").select("acting_id", "owner_id", "team_size")


def active_orders(carts: DataFrame) -> DataFrame:
    return carts.where(F.col("status").isin(*ACTIVE_STATUSES)).groupBy("supervisor_id").agg(
        F.count("*").alias("active_orders")
    )


def admin_kpis(t) -> DataFrame:
    """The administrator's counters in one row: one aggregate per table, stacked and folded."""
    status, role = F.col("status"), F.col("system_role")
    parts = [
        t.users.agg(
            F.count("*").alias("users_count"),
            F.count_if(role == "supervisor").alias("supervisor_count"),
            F.count_if(role == "admin").alias("admin_count"),
        ),
        t.team_members.agg(F.count("*").alias("team_count")),
        t.products.agg(F.count("*").alias("product_count")),
        t.order_carts.agg(
            F.count("*").alias("orders_count"),
            F.count_if(status.isin(*PENDING_STATUSES)).alias("pending_orders"),
            F.count_if(status == "completed").alias("total_orders"),
        ),
        t.product_sizes.agg(F.count_if(F.col("stock") <= LOW_STOCK).alias("low_stock")),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def supervisor_dashboard(t, as_of: dt.date) -> DataFrame:
    """One row per supervisor: active orders, team, budget use and band, garments listed (at most 10)."""
    garments = t.user_uniforms.groupBy(F.col("team_member_id").alias("id")).agg(F.count("*").alias("n"))
    listed = (
        garments.join(t.team_members.select("id", "supervisor_id"), "id")
        .groupBy("supervisor_id")
        .agg(F.least(F.sum("n"), F.lit(10)).cast("bigint").alias("uniforms_listed"))
    )
    bosses = t.users.where(F.col("system_role") == "supervisor").select(
        F.col("id").alias("supervisor_id"), "full_name", F.nullif("monthly_budget", F.lit(0)).alias("budget")
    )
    rows = (
        bosses.join(active_orders(t.order_carts), "supervisor_id", "left")
        .join(team_size(t.team_members), "supervisor_id", "left")
        .join(month_usage(t.order_carts, as_of), "supervisor_id", "left")
        .join(listed, "supervisor_id", "left")
        .withColumn("used", F.when(F.col("budget").isNotNull(), _zero("used")).otherwise(F.lit(0)))
    )
    rows = rows.withColumns(
        {
            "remaining": (F.col("budget") - F.col("used")).cast("double"),
            "budget": F.col("budget").cast("double"),
            "used": F.col("used").cast("double"),
        }
    ).withColumn(
        "used_percent",
        F.when(F.col("budget").isNotNull(), F.least(F.col("used") / F.col("budget") * 100, F.lit(100.0))),
    )
    return rows.select(
        "supervisor_id",
        "full_name",
        _zero("active_orders").cast("bigint").alias("active_orders"),
        _zero("team_size").cast("bigint").alias("team_size"),
        "budget",
        "used",
        "remaining",
        "used_percent",
        band(F.col("used_percent"), *BUDGET_CUTS).alias("budget_band"),
        _zero("uniforms_listed").cast("bigint").alias("uniforms_listed"),
    )


def month_revenue(carts: DataFrame, as_of: dt.date) -> DataFrame:
    done = carts.where((F.col("status") == "completed") & in_month(F.col("created_at"), as_of))
    return done.agg(F.coalesce(F.sum("total_price"), F.lit(0)).cast("double").alias("revenue"))


def revenue_by_month(carts: DataFrame) -> DataFrame:
    done = carts.where(F.col("status") == "completed")
    month = F.date_trunc("month", "created_at").cast("date").alias("month")
    return done.groupBy(month).agg(
        F.sum("total_price").cast("double").alias("revenue"), F.count("*").alias("orders")
    )


def spend_ranking(carts: DataFrame, users: DataFrame) -> DataFrame:
    """Supervisors by completed spend, with their place (ties by id)."""
    spent = carts.where(F.col("status") == "completed").groupBy("supervisor_id").agg(
        F.coalesce(F.sum("total_price"), F.lit(0)).alias("total")
    )
    names = users.select(F.col("id").alias("supervisor_id"), "full_name")
    placed = number_rows(
        spent.join(names, "supervisor_id"), [F.col("total").desc(), F.col("supervisor_id").asc()], "place"
    )
    return placed.select("place", "supervisor_id", "full_name", F.col("total").cast("double").alias("total_spent"))


def top_products(items: DataFrame, skus: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` products with most units in orders of any status (ties by id)."""
    per_sku = items.groupBy(F.col("product_size_id").alias("sku")).agg(F.sum("quantity").alias("units"))
    per_product = (
        per_sku.join(skus.select(F.col("id").alias("sku"), "product_id"), "sku")
        .groupBy("product_id")
        .agg(F.sum("units").cast("bigint").alias("total_quantity"))
    )
    names = products.select(F.col("id").alias("product_id"), "name")
    order = [F.col("total_quantity").desc(), F.col("product_id").asc()]
    best = per_product.join(names, "product_id").orderBy(*order).limit(k)
    return best.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"),
        "product_id",
        "name",
        "total_quantity",
    )


def value_counts(df: DataFrame, *columns: str, name: str = "count") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name))


def size_frequency(sizes: DataFrame) -> DataFrame:
    return value_counts(sizes, "product_type", "size", name="frequency").orderBy(
        "product_type", F.col("frequency").desc(), "size"
    )


def size_frequency_by_facility(sizes: DataFrame, team: DataFrame) -> DataFrame:
    places = team.select(F.col("id").alias("team_member_id"), "facility_id")
    return value_counts(sizes.join(places, "team_member_id"), "facility_id", "product_type", "size", name="frequency")


def orders_by_status(carts: DataFrame) -> DataFrame:
    return value_counts(carts, "status", name="orders")


def orders_by_supervisor(carts: DataFrame, users: DataFrame) -> DataFrame:
    counts = value_counts(carts, "supervisor_id", name="total")
    names = users.select(F.col("id").alias("supervisor_id"), "full_name")
    return counts.join(names, "supervisor_id").select("supervisor_id", "full_name", "total")


# Whole days that 28-digit arithmetic shows as one less.
SHORT_DAYS = [1, 4, 7, 10]


def days_of_stock(stock: Column, sold: Column) -> Column:
    """Whole days the stock lasts at ``sold`` units in 30 days, cut toward zero.

    The rule is defined on 28-digit decimals: stock / sold is rounded, then multiplied by
    30. Where the true result is a whole number below, the rounded quotient ends in 3s and
    its product stays just short of that number.
    """
    scaled = stock.cast("bigint") * 30
    whole = F.call_function("div", scaled, sold)
    short = (scaled % sold == 0) & F.abs(whole).isin(*SHORT_DAYS)
    return F.when(short, whole - F.signum(whole.cast("double")).cast("bigint")).otherwise(whole)


def reorder_suggestions(t, mode: str = "reference", as_of: dt.datetime | None = None) -> DataFrame:
    """SKUs whose stock lasts less than 30 days at current use, with the amount to reorder.

    ``reference``: use is all units ever put in any cart. ``completed_month``: use is the
    units of orders completed in the 30 days up to ``as_of``.
    """
    items = t.order_items
    if mode == "completed_month":
        since = ntz(as_of - dt.timedelta(days=30))
        recent = t.order_carts.where(
            (F.col("status") == "completed") & (F.col("created_at") > since) & (F.col("created_at") <= ntz(as_of))
        )
        items = items.join(recent.select(F.col("id").alias("cart_id")), "cart_id", "left_semi")
    elif mode != "reference":
        raise ValueError(f"unknown mode {mode!r}")
    sold = items.groupBy(F.col("product_size_id").alias("sku_id")).agg(
        F.sum("quantity").cast("bigint").alias("monthly_usage")
    )
    names = t.products.select(F.col("id").alias("product_id"), "name")
    stock, used = F.col("stock"), F.col("monthly_usage")
    short = (
        t.product_sizes.select(F.col("id").alias("sku_id"), "product_id", "size", "stock")
        .join(sold, "sku_id")
        .where(((used > 0) & (stock < used)) | ((used < 0) & (stock > used)))
        .join(names, "product_id")
        .withColumn("days_remaining", days_of_stock(stock, used))
    )
    return short.select(
        "sku_id",
        "name",
        "size",
        "stock",
        "monthly_usage",
        "days_remaining",
        F.greatest(F.lit(0), used * 2 - stock).cast("bigint").alias("suggested_reorder"),
        band(stock, *STOCK_CUTS).alias("stock_band"),
        band(F.col("days_remaining"), *DAYS_CUTS, upper_closed=False).alias("days_band"),
    )


def order_totals(items: DataFrame) -> DataFrame:
    """Total of every order that has lines (DECIMAL)."""
    return items.groupBy("cart_id").agg(F.sum(F.col("quantity") * F.col("price_at_time")).alias("total"))


def total_mismatch(carts: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose stored total differs from the sum of their lines."""
    totals = order_totals(items).withColumnRenamed("cart_id", "id")
    both = carts.select("id", _zero("total_price").alias("stored")).join(totals, "id", "left")
    both = both.withColumn("computed", _zero("total"))
    return both.where(F.col("stored") != F.col("computed")).select(
        "id",
        F.col("stored").cast("double").alias("stored"),
        F.col("computed").cast("double").alias("computed"),
        (F.col("computed") - F.col("stored")).cast("double").alias("difference"),
    )


def with_engagement(posts: DataFrame, likes: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts with their numbers of likes and comments, 0 when there are none."""
    for marks, name in ((likes, "like_count"), (comments, "comment_count")):
        counts = value_counts(marks, "post_id", name=name).withColumnRenamed("post_id", "id")
        posts = posts.join(counts, "id", "left").withColumn(name, _zero(name))
    return posts


def post_engagement(posts: DataFrame, likes: DataFrame, comments: DataFrame) -> DataFrame:
    """Likes and comments per post."""
    return with_engagement(posts.select("id"), likes, comments)


def return_counts(garments: DataFrame) -> DataFrame:
    """Returned garments per reason button and in total; unlisted reasons count as other."""
    returned = garment_state(garments, "history").where(F.col("returned"))
    reason = F.col("return_reason")
    named = [r for r in RETURN_BUTTONS if r != "other"]
    return returned.agg(
        F.count("*").alias("total"),
        *[F.count_if(reason == r).alias(r) for r in named],
        F.count_if(~reason.isin(*named)).alias("other"),
    )


def latest_per(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps only ``k`` per group and task before the shuffle."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("_rn") <= k).drop("_rn")


def open_cart_latest(carts: DataFrame) -> DataFrame:
    """The newest open cart of each supervisor (ties: highest id)."""
    newest = F.max(F.struct("created_at", "id")).alias("newest")
    return (
        carts.where(F.col("status") == "created")
        .groupBy("supervisor_id")
        .agg(newest)
        .select("supervisor_id", F.col("newest.id").alias("cart_id"), F.col("newest.created_at").alias("created_at"))
    )


def recent_orders(t, k: int = 5) -> DataFrame:
    """The newest ``k`` orders of each supervisor, with the worker's name."""
    newest = latest_per(t.order_carts, "supervisor_id", [F.col("created_at").desc(), F.col("id").desc()], k)
    return join_spread_nulls(
        newest, worker_names(t.team_members), "team_member_id", "worker_id", ["id"]
    ).select(
        "supervisor_id", "id", "status", "created_at", F.col("total_price").cast("double").alias("total_price"),
        "worker_name",
    )


def derive_cart_worker(carts: DataFrame, items: DataFrame) -> DataFrame:
    """The cart's worker, or else the smallest id among its lines' workers."""
    first = items.groupBy(F.col("cart_id").alias("id")).agg(F.min("team_member_id").alias("line_worker"))
    return carts.select("id", "team_member_id").join(first, "id", "left").select(
        "id", F.coalesce("team_member_id", "line_worker").alias("team_member_id")
    )


def recommended_size(products: DataFrame, sizes: DataFrame, worker: int) -> DataFrame:
    """Each product with the worker's saved size for its type, ignoring case."""
    saved = (
        sizes.where(F.col("team_member_id") == worker)
        .groupBy(F.upper("product_type").alias("_type"))
        .agg(F.max("size").alias("recommended_size"))
    )
    typed = products.withColumn("_type", F.upper(F.coalesce("type", F.lit(""))))
    return typed.join(saved, "_type", "left").drop("_type")
