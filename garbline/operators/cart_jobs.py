"""Cart building, bulk orders and checkout, each over a whole batch of requests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.functions.first_come import FOLD, first_come
from garbline.functions.spread import CHUNK, join_spread_nulls, number_rows
from garbline.operators.joins import acting_pairs, with_price
from garbline.operators.reports import derive_cart_worker, month_usage, open_cart_latest, order_totals
from garbline.schemas import MONEY
from garbline.session import cut_lineage


def check_cart_requests(requests: DataFrame, t, as_of: dt.date) -> DataFrame:
    """Add ``reason`` to add-to-cart requests: why one is refused, NULL where it is accepted.

    ``requests``: seq, actor_id, actor_role, team_member_id, product_size_id, quantity. A
    supervisor orders for the own team and for teams delegated on the day. Requests for an
    unknown worker have no owner; as NULL keys they are dealt out over all tasks.
    """
    owners = t.team_members.select(F.col("id").alias("_worker"), F.col("supervisor_id").alias("owner_id"))
    # Written out, so that the join below is between plain shuffles, which can be split.
    covers = cut_lineage(
        acting_pairs(t.supervisor_delegations, as_of).select(
            F.col("acting_id").alias("actor_id"), F.col("owner_id").alias("_owner"), F.lit(True).alias("_covers")
        ),
        "covers",
    )
    owned = join_spread_nulls(requests, owners, "team_member_id", "_worker")
    checked = join_spread_nulls(owned, covers, "owner_id", "_owner", also=["actor_id"])
    in_team = F.coalesce((F.col("owner_id") == F.col("actor_id")) | F.col("_covers"), F.lit(False))
    reason = (
        F.when(F.col("actor_role") == "admin", "admins cannot order")
        .when(F.col("product_size_id").isNull(), "no size selected")
        .when((F.col("actor_role") == "supervisor") & ~in_team, "invalid team member")
        .when(F.col("_worker").isNull(), "unknown worker")
    )
    return checked.withColumn("reason", reason).select(*requests.columns, "reason")


def add_to_carts(requests: DataFrame, t, as_of: dt.date) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add requested lines to the actors' open carts.

    Requests as in ``check_cart_requests``. Returns (lines of the touched carts, new carts,
    rejects). An actor's newest open cart is reused, else one is created. The same (cart,
    SKU, worker) adds up and keeps the price it had first; a new line takes the current
    product price. A missing quantity is 1.
    """
    # Written once: both the rejects and the lines are read from it.
    checked = cut_lineage(check_cart_requests(requests, t, as_of), "checked")
    rejects = checked.where(F.col("reason").isNotNull())
    # One row per line from here on, computed once for all that follows.
    added = cut_lineage(
        checked.where(F.col("reason").isNull())
        .groupBy("actor_id", "product_size_id", "team_member_id")
        .agg(F.sum(F.coalesce("quantity", F.lit(1))).alias("quantity"), F.min("seq").alias("seq"))
    )

    actors = added.groupBy("actor_id").agg(F.min("seq").alias("first_seq"))
    latest = open_cart_latest(t.order_carts).select(F.col("supervisor_id").alias("actor_id"), "cart_id")
    homed = actors.join(latest, "actor_id", "left")
    top_id = F.coalesce(t.order_carts.agg(F.max("id")).scalar(), F.lit(0)) + 1
    fresh = number_rows(
        homed.where(F.col("cart_id").isNull()).drop("cart_id"),
        [F.col("first_seq").asc(), F.col("actor_id").asc()],
        "cart_id",
        top_id,
    )
    new_carts = fresh.select(
        F.col("cart_id").alias("id"), F.col("actor_id").alias("supervisor_id"), F.lit("created").alias("status")
    )
    carts = homed.where(F.col("cart_id").isNotNull()).select("actor_id", "cart_id").unionByName(
        fresh.select("actor_id", "cart_id")
    )

    # Old lines carry position -1, so the earliest entry of a key holds the price to keep.
    key = ["cart_id", "product_size_id", "team_member_id"]
    old = (
        t.order_items.join(carts.select("cart_id"), "cart_id", "left_semi")
        .groupBy(*key)
        .agg(F.sum("quantity").alias("quantity"), F.min("price_at_time").alias("price"))
        .withColumn("seq", F.lit(-1).cast("bigint"))
    )
    added = with_price(added.join(carts, "actor_id").drop("actor_id"), t.product_sizes, t.products)
    lines = old.unionByName(added).groupBy(*key).agg(
        F.sum("quantity").cast("bigint").alias("quantity"), F.min_by("price", "seq").alias("price_at_time")
    )
    return lines, new_carts, rejects


def bulk_order(orders: DataFrame, workers: DataFrame, lines: DataFrame, t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every chosen worker of an order gets every chosen SKU of that order, kept as its two factors.

    ``orders``: order_id, supervisor_id. ``workers``: order_id, team_member_id. ``lines``:
    order_id, product_size_id, quantity as text (empty or NULL is 1, zero or less is
    skipped). Returns (carts with their total, priced lines, rejects); no stock is taken and
    the status stays created. A quantity that is no whole number refuses its whole
    order. The items are the carts' workers times their lines: ``bulk_items`` writes them out.
    """
    given = F.nullif(F.trim("quantity"), F.lit(""))
    read = lines.withColumn("_read", F.coalesce(F.expr("try_cast(nullif(trim(quantity), '') AS INT)"), F.when(given.isNull(), 1)))
    bad = read.where(F.col("_read").isNull()).select("order_id").distinct()
    rejects = bad.join(orders, "order_id").select("order_id", "supervisor_id", F.lit("invalid quantity").alias("reason"))
    good = orders.join(bad, "order_id", "left_anti")
    wanted = read.join(good.select("order_id"), "order_id", "left_semi").where(F.col("_read") > 0)
    priced = with_price(wanted.withColumn("quantity", F.col("_read")).drop("_read"), t.product_sizes, t.products)
    priced = priced.withColumnRenamed("price", "price_at_time")
    filled = good.join(lines.select("order_id"), "order_id", "left_semi")
    # The total needs no pairing: the order's lines sum, times its workers.
    heads = workers.groupBy("order_id").agg(F.count("*").alias("workers"))
    sums = priced.groupBy("order_id").agg(
        F.sum(F.col("quantity") * F.col("price_at_time")).alias("_sum"), F.count("*").alias("_lines")
    )
    carts = (
        filled.join(heads, "order_id")
        .join(sums, "order_id", "left")
        .select(
            F.col("order_id").alias("id"),
            "supervisor_id",
            F.lit("created").alias("status"),
            "workers",
            F.coalesce("_lines", F.lit(0)).alias("lines"),
            F.coalesce(F.col("_sum") * F.col("workers"), F.lit(0)).alias("total_price"),
        )
    )
    return carts, priced, rejects


def bulk_items(carts: DataFrame, workers: DataFrame, priced: DataFrame) -> DataFrame:
    """The items of the given carts: each worker with each line. Meant for carts that are asked for."""
    keys = carts.select(F.col("id").alias("order_id"))
    mine = workers.join(keys, "order_id", "left_semi")
    return mine.join(priced, "order_id").select(
        F.col("order_id").alias("cart_id"), "product_size_id", "team_member_id", "quantity", "price_at_time"
    )


def budget_check(submitted: DataFrame, t, as_of: dt.date) -> DataFrame:
    """Add ``over_budget`` to carts (cart_id, supervisor_id, total).

    Submitted orders do not count as used, so the carts of a batch never affect each
    other's test. A NULL or zero budget is no limit, and meeting it exactly passes.
    """
    budgets = t.users.select(F.col("id").alias("supervisor_id"), F.nullif("monthly_budget", F.lit(0)).alias("budget"))
    known = submitted.join(budgets, "supervisor_id", "left").join(
        month_usage(t.order_carts, as_of), "supervisor_id", "left"
    )
    over = F.coalesce(F.coalesce("used", F.lit(0)) + F.col("total") > F.col("budget"), F.lit(False))
    return known.withColumn("used", F.coalesce("used", F.lit(0))).withColumn("over_budget", over)


def cart_demand(lines: DataFrame) -> DataFrame:
    """Units per cart and SKU, computed once: (cart_id, product_size_id, need, submitted_at)."""
    return cut_lineage(
        lines.groupBy("cart_id", "product_size_id").agg(
            F.sum("quantity").alias("need"), F.min("submitted_at").alias("submitted_at")
        )
    )


def allocate_stock(need: DataFrame, skus: DataFrame, chunk: int = CHUNK, seen: list | None = None, fold: int = FOLD) -> DataFrame:
    """(cart_id, accepted): all-or-nothing stock for carts in order of submission.

    ``need``: as from ``cart_demand``. A cart that fails takes nothing, so its units stay
    for later carts. Only carts that touch a SKU with more demand than stock can fail;
    ``first_come`` decides them.
    """
    stock = skus.select(F.col("id").alias("product_size_id"), "stock")
    # Written out, so that the joins below are between plain shuffles, which can be split.
    contested = cut_lineage(
        need.groupBy("product_size_id")
        .agg(F.sum("need").alias("demand"))
        .join(stock, "product_size_id", "left")
        .withColumn("stock", F.coalesce("stock", F.lit(-1)).cast("bigint"))
        .where(F.col("demand") > F.col("stock"))
        .select("product_size_id", "stock")
    )
    disputed = need.join(contested, "product_size_id")
    ranked = cut_lineage(
        number_rows(
            disputed.groupBy("cart_id").agg(F.min("submitted_at").alias("submitted_at")),
            [F.col("submitted_at").asc(), F.col("cart_id").asc()],
            "rank",
            0,
        ).select("cart_id", "rank")
    )
    claims = disputed.join(ranked, "cart_id").select("rank", F.col("product_size_id").alias("resource"), "need", "stock")
    rejected = ranked.join(first_come(claims, chunk, fold, seen), "rank").select("cart_id", F.lit(True).alias("_lost"))
    return need.select("cart_id").distinct().join(rejected, "cart_id", "left").select("cart_id", F.col("_lost").isNull().alias("accepted"))


def budget_verdicts(submissions: DataFrame, t, as_of: dt.date) -> DataFrame:
    """Submitted carts with total, used, budget and the refusal reason known before stock is tested.

    ``submissions``: cart_id, submitted_at. A cart submitted twice counts once, first time.
    """
    once = submissions.groupBy("cart_id").agg(F.min("submitted_at").alias("submitted_at"))
    owned = once.join(t.order_carts.select(F.col("id").alias("cart_id"), "supervisor_id"), "cart_id", "left")
    totals = order_totals(t.order_items)
    tested = budget_check(
        owned.join(totals, "cart_id", "left").withColumn("_empty", F.col("total").isNull()).withColumn(
            "total", F.coalesce("total", F.lit(0))
        ),
        t,
        as_of,
    )
    reason = (
        F.when(F.col("supervisor_id").isNull(), "cart not found")
        .when(F.col("_empty"), "cart is empty")
        .when(F.col("over_budget"), "monthly budget exceeded")
    )
    return tested.withColumn("reason", reason).select(
        "cart_id", "submitted_at", "supervisor_id", "total", "used", "budget", "reason"
    )


def checkout(
    submissions: DataFrame, t, as_of: dt.date, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Submit carts against budget and stock: (carts, skus, rejects), carts and SKUs as new versions.

    ``submissions``: cart_id, submitted_at, and optionally comment and team_member_id.
    """
    verdicts = cut_lineage(budget_verdicts(submissions, t, as_of))
    passed = verdicts.where(F.col("reason").isNull())
    lines = t.order_items.join(passed.select("cart_id", "submitted_at"), "cart_id").select(
        "cart_id", "submitted_at", "product_size_id", "quantity"
    )
    need = cart_demand(lines)
    outcome = allocate_stock(need, t.product_sizes, chunk)
    sold_out = outcome.where(~F.col("accepted")).select("cart_id", F.lit("not enough stock").alias("reason"))
    done = passed.drop("reason").join(outcome.where("accepted"), "cart_id", "left_semi")

    taken = (
        need.join(done.select("cart_id"), "cart_id", "left_semi")
        .groupBy(F.col("product_size_id").alias("id"))
        .agg(F.sum("need").alias("_taken"))
    )
    skus = t.product_sizes.join(taken, "id", "left").withColumn(
        "stock", (F.col("stock") - F.coalesce("_taken", F.lit(0))).cast("bigint")
    ).drop("_taken")

    extra = [c for c in ("comment", "team_member_id") if c in submissions.columns]
    asked = submissions.groupBy("cart_id").agg(
        *[F.min_by(c, "submitted_at").alias(f"_{c}") for c in extra], F.lit(True).alias("_asked")
    )
    unnamed = t.order_carts.select("id", F.lit(None).cast("bigint").alias("team_member_id"))
    workers = derive_cart_worker(
        unnamed.join(done.select(F.col("cart_id").alias("id")), "id", "left_semi"), t.order_items
    ).withColumnRenamed("team_member_id", "_line_worker")
    named = F.coalesce("_team_member_id", "_line_worker") if "team_member_id" in extra else F.col("_line_worker")
    news = (
        done.select(F.col("cart_id").alias("id"), F.col("total").cast(MONEY).alias("_total"))
        .join(workers, "id")
        .join(asked.withColumnRenamed("cart_id", "id"), "id")
        .withColumn("_worker", named)
    )
    is_done = F.col("_asked").isNotNull()
    columns = {
        "status": F.when(is_done, "submitted").otherwise(F.col("status")),
        "total_price": F.when(is_done, F.col("_total")).otherwise(F.col("total_price")),
        "team_member_id": F.when(is_done, F.col("_worker")).otherwise(F.col("team_member_id")),
    }
    kept = list(t.order_carts.columns)
    if "comment" in extra:
        if "comment" not in kept:
            kept.append("comment")
            columns["comment"] = F.col("_comment")
        else:
            columns["comment"] = F.when(is_done, F.col("_comment")).otherwise(F.col("comment"))
    carts = t.order_carts.join(news, "id", "left").withColumns(columns).select(*kept)
    rejects = verdicts.where(F.col("reason").isNotNull()).select("cart_id", "reason").unionByName(sold_out)
    return carts, skus, rejects
