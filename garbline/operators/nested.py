"""Rows with child rows attached as arrays or maps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.functions.spread import place_in_group
from garbline.operators.joins import delegations_in

PAGE_ITEMS = 1000


def nest(
    children: DataFrame,
    key: str,
    fields: list[str],
    name: str,
    page_items: int = PAGE_ITEMS,
    parents: DataFrame | None = None,
    late: tuple[str, ...] = (),
) -> DataFrame:
    """(key, page, name): children as arrays of structs, in the order of ``fields``, in pages by position.

    Page ``p`` holds the children at positions ``p * page_items`` and on, so the pages of a key, one
    after the other, are its sorted children, and no row has to hold a hot group. Only
    children of ``parents`` (one column of keys) are numbered, if it is given. ``late`` names columns of long
    values, which do not take part in the order: they are joined by ``id`` to the numbered rows,
    become the last fields, and are moved once.
    """
    if parents is not None:
        children = children.join(parents.toDF(key).distinct(), key, "left_semi")
    placed = place_in_group(children.select(key, *fields), key, fields, "_n")
    if late:
        placed = placed.join(children.select("id", *late), "id")
    paged = placed.withColumn("page", F.floor(F.col("_n") / page_items).cast("int"))
    items = F.sort_array(F.collect_list(F.struct("_n", F.struct(*fields, *late).alias("item"))))
    return paged.groupBy(key, "page").agg(F.transform(items, lambda x: x["item"]).alias(name))


def attach(parents: DataFrame, nested: DataFrame, parent_key: str, key: str, name: str) -> DataFrame:
    """Parents with their nested pages; a parent without children gets one empty page 0. Not ordered."""
    kind = nested.schema[name].dataType
    joined = parents.join(nested.withColumnRenamed(key, "_key"), parents[parent_key] == F.col("_key"), "left")
    return joined.withColumn("page", F.coalesce("page", F.lit(0))).withColumn(
        name, F.coalesce(name, F.array().cast(kind))
    ).drop("_key")


def size_pages(skus: DataFrame, page_items: int = PAGE_ITEMS, products: DataFrame | None = None) -> DataFrame:
    """(product_id, page, sizes) of all products or of those in the column ``products``."""
    return nest(skus, "product_id", ["id", "size", "stock"], "sizes", page_items, products)


def role_pages(links: DataFrame, page_items: int = PAGE_ITEMS, products: DataFrame | None = None) -> DataFrame:
    """(product_id, page, role_ids) of all products or of those in the column ``products``."""
    return nest(links, "product_id", ["job_role_id"], "role_ids", page_items, products).withColumn(
        "role_ids", F.transform("role_ids", lambda r: r["job_role_id"])
    )


def products_with_sizes(products: DataFrame, skus: DataFrame, page_items: int = PAGE_ITEMS) -> DataFrame:
    """Products with the array ``sizes`` of (id, size, stock)."""
    return attach(products, size_pages(skus, page_items, products.select("id")), "id", "product_id", "sizes")


def products_with_roles(products: DataFrame, links: DataFrame, page_items: int = PAGE_ITEMS) -> DataFrame:
    """Products with the array ``role_ids``."""
    return attach(products, role_pages(links, page_items, products.select("id")), "id", "product_id", "role_ids")


def size_map(sizes: DataFrame) -> DataFrame:
    """Worker sizes as a map from product type (upper case) to size."""
    per_type = sizes.groupBy("team_member_id", F.upper("product_type").alias("product_type")).agg(
        F.max("size").alias("size")
    )
    entry = F.sort_array(F.collect_list(F.struct("product_type", "size")))
    return per_type.groupBy("team_member_id").agg(F.map_from_entries(entry).alias("sizes"))


def group_rows(df: DataFrame, by: str, name: str = "rows", page_items: int = PAGE_ITEMS) -> DataFrame:
    """Rows grouped under ``by`` as an array in the order of the columns (delegated workers under their owner)."""
    return nest(df, by, [c for c in df.columns if c != by], name, page_items).orderBy(by, "page")


def delegations_with_members(t, as_of: dt.date, me: int | None = None, page_items: int = PAGE_ITEMS) -> DataFrame:
    """Incoming delegations of the day with the array ``members`` of (full_name, employee_number), newest start first."""
    incoming = delegations_in(t.supervisor_delegations, t.users, as_of, me)
    members = nest(t.team_members, "supervisor_id", ["full_name", "employee_number"], "members", page_items, incoming.select("owner_id"))
    return attach(incoming, members, "owner_id", "supervisor_id", "members").orderBy(F.col("start_date").desc(), "id", "page")


def to_json_docs(df: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct("*")).alias("doc"))
