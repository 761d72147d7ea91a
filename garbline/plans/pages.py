"""Pages composed from several operators: catalogue and news feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.operators.filters import audience, search_products
from garbline.operators.joins import eligible_products, post_comments, products_for_role, with_flags
from garbline.operators.nested import PAGE_ITEMS, attach, nest, role_pages, size_pages
from garbline.operators.reports import recommended_size, with_engagement


def catalogue_products(
    t, role: str, viewer_role_id: int | None = None, job_role: int | None = None, search: str | None = None
) -> DataFrame:
    """Products shown: the chosen role's, or all for staff, or those the viewer is eligible for."""
    if job_role is not None:
        shown = products_for_role(t.products, t.product_job_roles, job_role)
    elif role in ("admin", "supervisor"):
        shown = t.products
    else:
        shown = eligible_products(t.products, t.product_job_roles, t.job_roles, viewer_role_id)
    return search_products(shown, search)


def catalogue(
    t,
    role: str,
    worker: int | None = None,
    worker_role: int | None = None,
    viewer_role_id: int | None = None,
    job_role: int | None = None,
    search: str | None = None,
) -> DataFrame:
    """The catalogue page, flat: product, size counts and stock, recommended size, eligible flag.

    With a worker chosen, the worker's job role (``worker_role``) is the default filter and
    decides ``eligible``; without a role nothing is restricted and the flag is NULL.
    """
    chosen = job_role if job_role is not None else worker_role
    shown = catalogue_products(t, role, viewer_role_id, chosen, search)
    stock = t.product_sizes.groupBy("product_id").agg(
        F.count("*").alias("size_count"), F.sum("stock").alias("total_stock")
    )
    rows = shown.join(stock.withColumnRenamed("product_id", "id"), "id", "left")
    if worker is None:
        rows = rows.withColumn("recommended_size", F.lit(None).cast("string"))
    else:
        rows = recommended_size(rows, t.worker_sizes, worker)
    if worker is None or worker_role is None:
        rows = rows.withColumn("eligible", F.lit(None).cast("boolean"))
    else:
        allowed = eligible_products(t.products, t.product_job_roles, t.job_roles, worker_role).select(
            "id", F.lit(True).alias("_may")
        )
        rows = rows.join(allowed, "id", "left").withColumn("eligible", F.col("_may").isNotNull())
    return rows.select(
        "id",
        "article_number",
        "name",
        "type",
        F.col("price").cast("double").alias("price"),
        F.coalesce("size_count", F.lit(0)).alias("size_count"),
        F.coalesce("total_stock", F.lit(0)).cast("bigint").alias("total_stock"),
        "recommended_size",
        "eligible",
    ).orderBy("article_number")


def catalogue_nested(t, role: str, page_items: int = PAGE_ITEMS, **filters) -> DataFrame:
    """The catalogue's products with their arrays of sizes and of role ids, by article number.

    Page ``p`` of a product holds page ``p`` of either array; where one has fewer pages it is empty.
    """
    shown = catalogue_products(t, role, **filters)
    sizes, roles = size_pages(t.product_sizes, page_items, shown.select("id")), role_pages(t.product_job_roles, page_items, shown.select("id"))
    both = sizes.join(roles, ["product_id", "page"], "full_outer")
    rows = shown.join(both.withColumnRenamed("product_id", "_key"), shown["id"] == F.col("_key"), "left").drop("_key")
    empty = {name: F.coalesce(name, F.array().cast(both.schema[name].dataType)) for name in ("sizes", "role_ids")}
    return rows.withColumns(empty | {"page": F.coalesce("page", F.lit(0))}).orderBy("article_number", "id", "page")


FEED_ORDER = ["pinned", "created_at", "id"]


def _marked_posts(t, viewer: int, role: str) -> DataFrame:
    """The viewer's posts with flags, likes and number of comments, but without their text."""
    authors = t.users.select(F.col("id").alias("created_by"), "full_name")
    known = t.users.select(F.col("id").alias("user_id"))
    said = t.news_comments.join(known, "user_id", "left_semi")
    shown = audience(t.news_posts, role).drop("content")
    marked = with_engagement(with_flags(shown, t.news_reads, t.news_likes, viewer), t.news_likes, said)
    return marked.join(authors, "created_by", "left").withColumn("pinned", F.coalesce("pinned", F.lit(0)))


def _with_text(t, posts: DataFrame) -> DataFrame:
    """The text is joined once, when everything else is known."""
    return posts.join(t.news_posts.select("id", "content"), "id")


FEED = [
    "id", "title", "content", "target_role", "created_at", "pinned", "full_name", "is_read", "like_count", "user_liked",
    "comment_count",
]


def news_feed(t, viewer: int, role: str) -> DataFrame:
    """Posts for the viewer, pinned first, then newest: author, flags, likes, number of comments."""
    return _with_text(t, _marked_posts(t, viewer, role)).select(*FEED).orderBy(*[F.col(c).desc() for c in FEED_ORDER])


def news_feed_nested(t, viewer: int, role: str, page_items: int = PAGE_ITEMS) -> DataFrame:
    """The news feed with the array ``comments`` (oldest first), in pages by position."""
    marked = _marked_posts(t, viewer, role)
    said = post_comments(t.news_comments, t.users)
    fields = ["created_at", "id", "user_id", "full_name"]
    comments = nest(said, "post_id", fields, "comments", page_items, audience(t.news_posts, role).select("id"), late=("comment",))
    paged = attach(marked, comments, "id", "post_id", "comments")
    rows = _with_text(t, paged).select(*FEED, "page", "comments")
    return rows.orderBy(*[F.col(c).desc() for c in FEED_ORDER], "page")
