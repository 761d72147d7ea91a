"""Joined relations: order lines, people, delegation, eligibility, garments, news."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garbline.functions.spread import join_reduced, join_spread_nulls
from garbline.functions.text import reason_label
from garbline.operators.filters import active_delegations, audience, garment_state
from garbline.schemas import MONEY, ROLE_EVERYONE


def for_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among the keys."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def sku_names(skus: DataFrame, products: DataFrame) -> DataFrame:
    """SKU id with its size and its product's name, article number and price."""
    named = products.select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), "article_number", "price"
    )
    return skus.select(F.col("id").alias("product_size_id"), "product_id", "size").join(named, "product_id")


def worker_names(team: DataFrame) -> DataFrame:
    return team.select(
        F.col("id").alias("worker_id"), F.col("full_name").alias("worker_name"), "employee_number"
    )


def _subtotal():
    return F.col("quantity") * F.col("price_at_time")


def _with_worker(lines: DataFrame, team: DataFrame, by: list[str] | None = None) -> DataFrame:
    return join_spread_nulls(lines, worker_names(team), "team_member_id", "worker_id", by)


def order_lines(
    items: DataFrame, skus: DataFrame, products: DataFrame, team: DataFrame, cart_id: int | None = None
) -> DataFrame:
    """Order lines with product, size, worker and subtotal: the cart and the order page."""
    if cart_id is not None:
        items = items.where(F.col("cart_id") == cart_id)
    lines = items.select("cart_id", "product_size_id", "team_member_id", "quantity", "price_at_time")
    named = lines.join(sku_names(skus, products).drop("price", "product_id"), "product_size_id")
    return _with_worker(named, team).select(
        "cart_id",
        "product_name",
        "article_number",
        "size",
        "quantity",
        F.col("price_at_time").cast("double").alias("price_at_time"),
        _subtotal().cast("double").alias("subtotal"),
        "worker_name",
        "employee_number",
    )


def order_header(carts: DataFrame, users: DataFrame, team: DataFrame, cart_id: int | None = None) -> DataFrame:
    """Orders with their owner and, where one is named, their worker."""
    if cart_id is not None:
        carts = carts.where(F.col("id") == cart_id)
    owners = users.select(F.col("id").alias("supervisor_id"), F.col("full_name").alias("supervisor_name"))
    return (
        _with_worker(carts.join(owners, "supervisor_id"), team, ["id"])
        .select(
            F.col("id").alias("order_id"),
            "supervisor_id",
            "status",
            "created_at",
            F.col("total_price").cast("double").alias("total_price"),
            "supervisor_name",
            "worker_name",
            "employee_number",
        )
    )


def order_contact(carts: DataFrame, users: DataFrame) -> DataFrame:
    """Order id with the owner's id, name and e-mail address."""
    owners = users.select(F.col("id").alias("supervisor_id"), "full_name", "email")
    return carts.select(F.col("id").alias("order_id"), "supervisor_id").join(owners, "supervisor_id")


def wide_order_lines(t, carts: DataFrame | None = None) -> DataFrame:
    """Order lines joined to order, owner, SKU, product and worker; orders without lines drop out.

    Small sides meet first (SKU with product, order with owner), then the lines. What a join adds to the lines goes
    through all later shuffles, so the narrowest side is joined first and the orders, with the widest, last.
    """
    carts = t.order_carts if carts is None else carts
    owners = t.users.select(F.col("id").alias("supervisor_id"), F.col("full_name").alias("supervisor"))
    orders = carts.select(
        F.col("id").alias("cart_id"), "supervisor_id", "status", "created_at", "total_price"
    ).join(owners, "supervisor_id")
    catalogue = sku_names(t.product_sizes, t.products).drop("price", "product_id")
    lines = t.order_items.select("cart_id", "product_size_id", "team_member_id", "quantity", "price_at_time")
    named = _with_worker(lines, t.team_members).drop("team_member_id", "worker_id")
    return named.join(catalogue, "product_size_id").join(orders, "cart_id").select(
        F.col("cart_id").alias("order_id"),
        "status",
        "created_at",
        "total_price",
        "supervisor",
        F.col("product_name").alias("product"),
        "article_number",
        "size",
        "quantity",
        "price_at_time",
        _subtotal().alias("subtotal"),
        F.col("worker_name").alias("worker"),
        "employee_number",
    )


def user_directory(users: DataFrame, roles: DataFrame, facilities: DataFrame) -> DataFrame:
    """Users with role, facility and superior, newest first."""
    people = users.select("id", "email", "system_role", "full_name", "supervisor_id", "job_role_id", "facility_id")
    role_names = roles.select(F.col("id").alias("job_role_id"), F.col("name").alias("job_role"))
    bosses = users.select(F.col("id").alias("boss_id"), F.col("full_name").alias("supervisor_name"))
    places = facilities.select(F.col("id").alias("facility_id"), F.col("name").alias("facility_name"))
    return (
        join_spread_nulls(people, bosses, "supervisor_id", "boss_id", ["id"])
        .join(role_names, "job_role_id", "left")
        .join(places, "facility_id", "left")
        .select(
            "id", "email", "system_role", "full_name", "supervisor_id", "job_role", "supervisor_name", "facility_name"
        )
        .orderBy(F.col("id").desc())
    )


def team_roster(team: DataFrame, roles: DataFrame, supervisor: int | None = None) -> DataFrame:
    if supervisor is not None:
        team = team.where(F.col("supervisor_id") == supervisor)
    names = roles.select(F.col("id").alias("job_role_id"), F.col("name").alias("job_role"))
    return team.join(names, "job_role_id", "left").select(
        "supervisor_id", "full_name", "employee_number", "job_role"
    )


def unread_posts(posts: DataFrame, reads: DataFrame, viewer: int, role: str) -> DataFrame:
    """Posts in the viewer's audience without a read mark of the viewer."""
    seen = reads.where(F.col("user_id") == viewer).select(F.col("post_id").alias("id"))
    return audience(posts, role).join(seen, "id", "left_anti")


def unread_counts(posts: DataFrame, reads: DataFrame, users: DataFrame) -> DataFrame:
    """Unread posts of every user: posts in the audience minus those of them already read.

    Counted per target role, so no user-by-post pairs arise.
    """
    targets = posts.select(F.col("id").alias("post_id"), "target_role")
    sizes = targets.groupBy("target_role").agg(F.count("*").alias("n"))
    for_all = F.coalesce(sizes.where(F.col("target_role") == "all").select("n").scalar(), F.lit(0))
    viewers = users.select(F.col("id").alias("user_id"), "system_role")
    seen = (
        reads.join(targets, "post_id")
        .groupBy("user_id", "target_role")
        .agg(F.count("*").alias("n_read"))
        .join(viewers, "user_id")
        .where(F.col("target_role").isin("all") | (F.col("target_role") == F.col("system_role")))
        .groupBy("user_id")
        .agg(F.sum("n_read").alias("n_read"))
    )
    own = sizes.where(F.col("target_role") != "all").select(F.col("target_role").alias("system_role"), "n")
    return (
        viewers.join(own, "system_role", "left")
        .join(seen, "user_id", "left")
        .select(
            "user_id",
            "system_role",
            (F.coalesce("n", F.lit(0)) + for_all - F.coalesce("n_read", F.lit(0))).cast("bigint").alias(
                "unread_news_count"
            ),
        )
    )


def with_flags(posts: DataFrame, reads: DataFrame, likes: DataFrame, viewer: int) -> DataFrame:
    """Posts with the viewer's ``is_read`` and ``user_liked``."""
    for marks, flag in ((reads, "is_read"), (likes, "user_liked")):
        mine = marks.where(F.col("user_id") == viewer).select(F.col("post_id").alias("id")).distinct()
        posts = posts.join(mine.withColumn(flag, F.lit(True)), "id", "left").withColumn(
            flag, F.col(flag).isNotNull()
        )
    return posts


def post_flags(posts: DataFrame, reads: DataFrame, likes: DataFrame, viewer: int) -> DataFrame:
    """Post id with the viewer's ``is_read`` and ``user_liked``."""
    return with_flags(posts.select("id"), reads, likes, viewer)


def _everyone_links(links: DataFrame, roles: DataFrame) -> DataFrame:
    everyone = roles.where(F.col("name") == ROLE_EVERYONE).select(F.col("id").alias("job_role_id"))
    return links.join(everyone, "job_role_id", "left_semi").select("product_id").distinct()


def eligible_products(products: DataFrame, links: DataFrame, roles: DataFrame, job_role: int | None) -> DataFrame:
    """Products for one job role or for everyone; without a role, for everyone only."""
    everyone = _everyone_links(links, roles)
    own = links.where(F.col("job_role_id") == F.lit(job_role).cast("bigint")).select("product_id")
    keys = own.union(everyone).select(F.col("product_id").alias("id"))
    return products.join(keys, "id", "left_semi")


def eligibility(team: DataFrame, links: DataFrame, roles: DataFrame) -> DataFrame:
    """Which products workers may order, with the number of workers each row reaches.

    Eligibility depends on the role alone, so it is kept per role instead of per (worker,
    product): rows that reach everyone, and for each role in use the products beyond
    those. A worker's products are the rows of the own role and the rows for everyone.
    """
    everyone = _everyone_links(links, roles)
    staffed = (
        team.where(F.col("job_role_id").isNotNull())
        .groupBy("job_role_id")
        .agg(F.count("*").alias("workers"))
    )
    own = (
        links.join(everyone, "product_id", "left_anti")
        .join(staffed, "job_role_id")
        .select(F.lit("role").alias("reach"), "job_role_id", "product_id", "workers")
    )
    shared = everyone.select(
        F.lit("everyone").alias("reach"),
        F.lit(None).cast("bigint").alias("job_role_id"),
        "product_id",
        team.agg(F.count("*")).scalar().alias("workers"),
    )
    return own.unionByName(shared)


def products_for_role(products: DataFrame, links: DataFrame, role: int) -> DataFrame:
    """Products linked to the chosen role itself, by article number."""
    keys = links.where(F.col("job_role_id") == role).select(F.col("product_id").alias("id"))
    return products.join(keys, "id", "left_semi").orderBy("article_number")


def acting_pairs(delegations: DataFrame, as_of: dt.date) -> DataFrame:
    """(acting_id, owner_id): supervisors who act for another one on the day. Not transitive."""
    live = active_delegations(delegations, as_of).where(
        F.col("from_supervisor_id") != F.col("to_supervisor_id")
    )
    return live.select(
        F.col("to_supervisor_id").alias("acting_id"), F.col("from_supervisor_id").alias("owner_id")
    ).distinct()


def effective_team(
    team: DataFrame, delegations: DataFrame, as_of: dt.date, supervisor: int | None = None
) -> DataFrame:
    """Workers a supervisor may act for: the own team and those delegated on the day.

    The pairs are distinct and never reflexive, so the union needs no distinct.
    """
    members = team.select(F.col("id").alias("team_member_id"), "full_name", F.col("supervisor_id").alias("owner_id"))
    pairs = acting_pairs(delegations, as_of)
    own = members.withColumn("acting_id", F.col("owner_id"))
    if supervisor is not None:
        own = own.where(F.col("owner_id") == supervisor)
        pairs = pairs.where(F.col("acting_id") == supervisor)
    return own.unionByName(members.join(pairs, "owner_id")).select(
        "acting_id", "owner_id", "team_member_id", "full_name"
    )


SPAN_DAYS = 32


def interval_join(facts: DataFrame, spans: DataFrame, key: str, day: str, start: str, end: str, width: int = SPAN_DAYS) -> DataFrame:
    """Facts with every span of the same ``key`` whose [``start``, ``end``] contains the fact's ``day``.

    Days fall into buckets of ``width`` days. A span stands in every bucket it touches, a fact in one, so they
    meet by an equi-join on key and bucket, which splits a hot key by time, and the bounds are
    tested where they meet. Spans are cut to the days that facts have, so open-ended ones stay short.
    NULL keys, days and bounds match nothing. Other columns of either side are kept.
    """
    bucket = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / width)
    known = facts.agg(F.min(F.col(day).cast("date")).alias("low"), F.max(F.col(day).cast("date")).alias("high"))
    low, high = known.select("low").scalar(), known.select("high").scalar()
    touched = spans.where((F.col(end) >= low) & (F.col(start) <= high) & (F.col(start) <= F.col(end)))
    first, last = F.greatest(F.col(start).cast("date"), low), F.least(F.col(end).cast("date"), high)
    buckets = F.sequence(F.floor(F.unix_date(first) / width), F.floor(F.unix_date(last) / width))
    dealt = touched.withColumn("_bucket", F.explode(buckets))
    met = facts.withColumn("_bucket", bucket(day)).join(dealt, [key, "_bucket"])
    return met.where(F.col(day).cast("date").between(F.col(start), F.col(end))).drop("_bucket")


def merged_spans(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Spans of equal ``keys`` that overlap or follow each other become one; inverted ones and NULL bounds go."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > F.date_add(reach, 1)), 1).otherwise(0)
    islands = spans.where(F.col(start) <= F.col(end)).withColumn("_new", new)
    numbered = islands.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def orders_by_authority(carts: DataFrame, delegations: DataFrame, width: int = SPAN_DAYS) -> DataFrame:
    """(order_id, owner_id, day, actor_id, reason): who could act for the owner on the day of each order.

    The owner, and whoever held a delegation of the owner's that day, once each. Admins may act for anybody
    on any day and are not listed. Orders without an owner or a date have no row but their owner's.
    """
    orders = carts.select(F.col("id").alias("order_id"), F.col("supervisor_id").alias("owner_id"), F.col("created_at").cast("date").alias("day"))
    given = delegations.where(F.col("from_supervisor_id") != F.col("to_supervisor_id")).select(
        F.col("from_supervisor_id").alias("owner_id"), F.col("to_supervisor_id").alias("actor_id"), "start_date", "end_date"
    )
    held = merged_spans(given, ["owner_id", "actor_id"], "start_date", "end_date")
    delegates = interval_join(orders, held, "owner_id", "day", "start_date", "end_date", width)
    own = orders.where(F.col("owner_id").isNotNull()).withColumn("actor_id", F.col("owner_id")).withColumn("reason", F.lit("self"))
    return own.unionByName(delegates.withColumn("reason", F.lit("delegate")).drop("start_date", "end_date"))


def authority_pairs(users: DataFrame, delegations: DataFrame, as_of: dt.date) -> DataFrame:
    """Who may act for which supervisor. An admin may act for all: one row with NULL for the supervisor."""
    own = users.where(F.col("system_role") == "supervisor").select(
        F.col("id").alias("actor_id"), F.col("id").alias("supervisor_id"), F.lit("self").alias("reason")
    )
    delegated = acting_pairs(delegations, as_of).select(
        F.col("acting_id").alias("actor_id"), F.col("owner_id").alias("supervisor_id"), F.lit("delegate").alias("reason")
    )
    admins = users.where(F.col("system_role") == "admin").select(
        F.col("id").alias("actor_id"), F.lit(None).cast("bigint").alias("supervisor_id"), F.lit("admin").alias("reason")
    )
    return own.unionByName(delegated).unionByName(admins)


def may_act(requests: DataFrame, authority: DataFrame) -> DataFrame:
    """Requests (actor_id, supervisor_id, ..) that the authority relation allows."""
    admins = authority.where(F.col("supervisor_id").isNull()).select("actor_id", F.lit(True).alias("_any"))
    pairs = authority.where(F.col("supervisor_id").isNotNull()).select(
        "actor_id", "supervisor_id", F.lit(True).alias("_pair")
    )
    return (
        requests.join(admins, "actor_id", "left")
        .join(pairs, ["actor_id", "supervisor_id"], "left")
        .where(F.col("_any") | F.col("_pair") | (F.col("actor_id") == F.col("supervisor_id")))
        .select(*requests.columns)
    )


def worker_history(t, worker: int | None = None) -> DataFrame:
    """Order lines of workers with the states of the garments of the same SKU and worker.

    The join key is not unique on either side. Garments are counted per status first, so a
    line meets at most one row per status; ``copies`` says how many garments that row stands for.
    """
    items = t.order_items.where(F.col("team_member_id").isNotNull())
    garments = t.user_uniforms.where(F.col("team_member_id").isNotNull())
    if worker is not None:
        items = items.where(F.col("team_member_id") == worker)
        garments = garments.where(F.col("team_member_id") == worker)
    key = ["product_size_id", "team_member_id"]
    states = garments.groupBy(*key, F.col("status").alias("uniform_status")).agg(
        F.count("*").alias("_garments")
    )
    orders = t.order_carts.select(
        F.col("id").alias("cart_id"), F.col("created_at").alias("order_date"), "status"
    )
    catalogue = sku_names(t.product_sizes, t.products).select("product_size_id", "product_name", "size")
    rows = (
        join_reduced(items.select(*key, "cart_id", "quantity"), states, key, "left")
        .join(orders, "cart_id")
        .join(catalogue, "product_size_id")
    )
    return garment_state(rows, "history", "uniform_status").select(
        "team_member_id",
        F.col("cart_id").alias("order_id"),
        "order_date",
        "status",
        "product_name",
        "size",
        "quantity",
        "uniform_status",
        "returned",
        "return_reason",
        F.coalesce("_garments", F.lit(1)).alias("copies"),
    )


GARMENT_ORDER = ["issued_at", "product_size_id", "team_member_id", "status"]


def team_garments(t, supervisor: int | None = None, limit: int | None = None) -> DataFrame:
    """Garments of the workers of one or all supervisors; ``limit`` keeps the newest per supervisor."""
    team = t.team_members if supervisor is None else t.team_members.where(F.col("supervisor_id") == supervisor)
    workers = team.select(
        F.col("id").alias("team_member_id"), F.col("full_name").alias("worker_name"), "supervisor_id"
    )
    garments = t.user_uniforms.drop("user_id").join(workers, "team_member_id")
    if limit is not None:
        newest = Window.partitionBy("supervisor_id").orderBy(*[F.col(c).desc() for c in GARMENT_ORDER])
        garments = garments.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= limit).drop("_rn")
    catalogue = sku_names(t.product_sizes, t.products).select("product_size_id", "product_name", "size")
    return garment_state(garments.join(catalogue, "product_size_id"), "team").select(
        "supervisor_id", "worker_name", "product_name", "size", "status", "issued_at", "returned_at", "returned",
        "return_reason",
    )


def user_garments(t, user: int | None = None) -> DataFrame:
    """Garments issued to users themselves."""
    garments = t.user_uniforms.where(F.col("user_id").isNotNull())
    if user is not None:
        garments = garments.where(F.col("user_id") == user)
    catalogue = sku_names(t.product_sizes, t.products).select("product_size_id", "product_name", "size")
    return garment_state(garments.join(catalogue, "product_size_id"), "team").select(
        "user_id", "product_name", "size", "status", "issued_at", "returned_at", "returned", "return_reason"
    )


def with_price(items: DataFrame, skus: DataFrame, products: DataFrame) -> DataFrame:
    """Add the SKU's current product price; 0 where SKU, product or price is missing."""
    prices = (
        skus.select(F.col("id").alias("product_size_id"), "product_id")
        .join(products.select(F.col("id").alias("product_id"), "price"), "product_id")
        .select("product_size_id", "price")
    )
    return items.join(prices, "product_size_id", "left").withColumn(
        "price", F.coalesce("price", F.lit(0).cast(MONEY))
    )


def delegations_out(delegations: DataFrame, users: DataFrame, me: int | None = None) -> DataFrame:
    """Delegations given, with the delegate's name, newest start first."""
    if me is not None:
        delegations = delegations.where(F.col("from_supervisor_id") == me)
    names = users.select(F.col("id").alias("to_supervisor_id"), F.col("full_name").alias("delegate_name"))
    return delegations.join(names, "to_supervisor_id").select(
        "id", "from_supervisor_id", "to_supervisor_id", "start_date", "end_date", "delegate_name"
    ).orderBy(F.col("start_date").desc(), "id")


def delegations_in(
    delegations: DataFrame, users: DataFrame, as_of: dt.date, me: int | None = None
) -> DataFrame:
    """Delegations received that hold on the day, with the owner."""
    live = active_delegations(delegations, as_of)
    if me is not None:
        live = live.where(F.col("to_supervisor_id") == me)
    owners = users.select(F.col("id").alias("from_supervisor_id"), F.col("full_name").alias("owner_name"))
    return live.join(owners, "from_supervisor_id").select(
        "id", "to_supervisor_id", "start_date", "end_date", "owner_name", F.col("from_supervisor_id").alias("owner_id")
    ).orderBy(F.col("start_date").desc(), "id")


def post_comments(comments: DataFrame, users: DataFrame, post: int | None = None) -> DataFrame:
    """Comments with their author, oldest first."""
    if post is not None:
        comments = comments.where(F.col("post_id") == post)
    authors = users.select(F.col("id").alias("user_id"), "full_name")
    return comments.join(authors, "user_id").select(
        "id", "post_id", "user_id", "comment", "created_at", "full_name"
    ).orderBy("created_at", "id")


def returns_report(t, reason: str | None = None) -> DataFrame:
    """Returned garments with worker, supervisor, product, reason and the orders they came from.

    A garment knows its SKU and worker, not its order, and several orders may fit. They
    are summed up per (SKU, worker) as count, first and last, so each garment is one row;
    ``return_orders`` lists them.
    """
    returned = garment_state(t.user_uniforms, "history").where(F.col("returned"))
    if reason is not None:
        returned = returned.where(F.col("return_reason") == reason)
    key = ["product_size_id", "team_member_id"]
    orders = (
        t.order_items.where(F.col("team_member_id").isNotNull())
        .groupBy(*key)
        .agg(
            F.count_distinct("cart_id").alias("order_count"),
            F.min("cart_id").alias("first_order_id"),
            F.max("cart_id").alias("last_order_id"),
        )
    )
    workers = t.team_members.select(
        F.col("id").alias("worker_id"), F.col("full_name").alias("worker_name"), "supervisor_id"
    )
    bosses = t.users.select(F.col("id").alias("supervisor_id"), F.col("full_name").alias("supervisor_name"))
    catalogue = sku_names(t.product_sizes, t.products).select("product_size_id", "product_name", "size")
    named = join_spread_nulls(
        join_reduced(returned, orders, key, "left").join(catalogue, "product_size_id"),
        workers.join(bosses, "supervisor_id", "left"),
        "team_member_id",
        "worker_id",
    )
    return named.select(
        "returned_at",
        "worker_name",
        "supervisor_name",
        "product_name",
        "size",
        "return_reason",
        reason_label(F.col("return_reason")).alias("reason_label"),
        F.coalesce("order_count", F.lit(0)).alias("order_count"),
        "first_order_id",
        "last_order_id",
    )


def return_orders(t) -> DataFrame:
    """(SKU, worker, order): the orders that returned garments may have come from."""
    key = ["product_size_id", "team_member_id"]
    returned = garment_state(t.user_uniforms, "history").where(F.col("returned")).select(*key).distinct()
    named = t.order_items.where(F.col("team_member_id").isNotNull())
    lines = named.select(*key, F.col("cart_id").alias("order_id")).distinct()
    return join_reduced(lines, returned, key, "left_semi")
