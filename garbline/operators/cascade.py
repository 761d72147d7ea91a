"""Cascading deletes along a declared graph of references."""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.functions.spread import join_spread_nulls
from garbline.session import cut_lineage


@dataclass(frozen=True)
class Reference:
    """``child.column`` names the key of ``parent``. Deleting the parent deletes the child, or is refused.

    References that a plan does not list stay as they are, with or without their parent.
    """

    child: str
    column: str
    parent: str
    refuse: bool = False


@dataclass(frozen=True)
class Plan:
    """References between tables whose key is ``keys.get(table, "id")``; a table without key has None there."""

    references: tuple[Reference, ...]
    keys: dict[str, str | None]

    def key(self, table: str) -> str | None:
        return self.keys.get(table, "id")

    def order(self, root: str) -> list[str]:
        """The tables that a delete of ``root`` rows reaches, every parent before its children."""
        reached, todo = {root}, [root]
        while todo:
            table = todo.pop()
            for r in self.references:
                if r.parent == table and not r.refuse and r.child not in reached:
                    reached.add(r.child)
                    todo.append(r.child)
        inner = [r for r in self.references if not r.refuse and r.parent in reached]
        out: list[str] = []
        while len(out) < len(reached):
            free = [t for t in sorted(reached) if t not in out and all(r.parent in out for r in inner if r.child == t)]
            if not free:
                raise ValueError(f"references in a circle: {sorted(reached - set(out))}")
            out += free
        for r in inner:
            if self.key(r.parent) is None:
                raise ValueError(f"{r.parent} has no key for {r.child}.{r.column}")
        return out


# What hangs on what. Issued garments and news authors outlive products and users.
WORKWEAR = Plan(
    (
        Reference("team_members", "supervisor_id", "users"),
        Reference("order_carts", "supervisor_id", "users"),
        Reference("worker_sizes", "team_member_id", "team_members"),
        Reference("user_uniforms", "team_member_id", "team_members"),
        Reference("order_items", "team_member_id", "team_members"),
        Reference("order_items", "cart_id", "order_carts"),
        Reference("product_sizes", "product_id", "products"),
        Reference("product_job_roles", "product_id", "products"),
        Reference("order_items", "product_size_id", "product_sizes"),
        Reference("news_comments", "post_id", "news_posts"),
        Reference("news_likes", "post_id", "news_posts"),
        Reference("news_reads", "post_id", "news_posts"),
        Reference("users", "facility_id", "facilities", refuse=True),
        Reference("team_members", "facility_id", "facilities", refuse=True),
        Reference("users", "job_role_id", "job_roles", refuse=True),
        Reference("team_members", "job_role_id", "job_roles", refuse=True),
        Reference("product_job_roles", "job_role_id", "job_roles", refuse=True),
        Reference("user_sites", "site_id", "sites", refuse=True),
    ),
    {name: None for name in ("worker_sizes", "user_uniforms", "order_items", "product_job_roles", "news_likes", "news_reads", "user_sites")},
)


def _without(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not among the one-column ``keys``; NULLs stay."""
    if dict(df.dtypes)[column] == "string":
        return df.join(keys.toDF(column), column, "left_anti").select(*df.columns)
    return join_spread_nulls(df, keys.toDF("_key"), column, "_key", how="left_anti")


def cascade_delete(t: SimpleNamespace, root: str, doomed: DataFrame, plan: Plan = WORKWEAR) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete the rows of table ``root`` named by ``doomed`` (one column of keys), with all that hangs on them.

    Returns every table that the delete reaches, as it remains, and the refused ``root_id``.
    Keys are carried down table by table together with the root they hang on, so a row that may not
    go (a listed reference with ``refuse`` leads to it, from a row that the same root does not take
    along) holds back its own root and nothing else. Every set of keys is written once, as
    every table below reads it. Keys that no row has are ignored. References in a circle raise ValueError.
    """
    order = plan.order(root)
    guards = [r for r in plan.references if r.refuse and r.parent in order]
    asked = doomed.toDF("root_id").where("root_id is not null").distinct()
    present = getattr(t, root).select(F.col(plan.key(root)).alias("root_id"))
    # Where nothing can be refused, all roots are alike and keys alone are carried.
    named_root = F.col("root_id") if guards else F.lit(None).cast(present.schema["root_id"].dataType)
    found = asked.join(present, "root_id", "left_semi").select(named_root.alias("root_id"), F.col("root_id").alias("key"))
    taken = {root: cut_lineage(found, "doomed")}
    parents = {r.parent for r in plan.references if r.parent in order}
    into = lambda table: [r for r in plan.references if r.child == table and r.parent in taken and not r.refuse]

    def hung(reference: Reference) -> DataFrame:
        """Rows of the child under their roots, with the child's key as ``key`` if it has one."""
        child, key = getattr(t, reference.child), plan.key(reference.child)
        named = child.where(F.col(reference.column).isNotNull()).select(
            F.col(reference.column).alias("key"), *([F.col(key).alias("child_key")] if key else [])
        )
        under = named.join(taken[reference.parent], "key")
        return under.select("root_id", F.col("child_key").alias("key")) if key else under.select("root_id")

    for table in order[1:]:
        if table in parents:
            found = [hung(r) for r in into(table)]
            rows = found[0]
            for more in found[1:]:
                rows = rows.unionByName(more)
            taken[table] = cut_lineage(rows.distinct(), "doomed")

    refused = taken[root].select("root_id").limit(0)
    gone = {name: keys.select("key") for name, keys in taken.items()}
    for r in guards:
        if r.parent in taken:
            rows = hung(r)
            if r.child in taken:
                rows = rows.join(taken[r.child], ["root_id", "key"], "left_anti")
            refused = refused.unionByName(rows.select("root_id"))
    if guards:
        refused = cut_lineage(refused.distinct(), "refused")
        gone = {name: cut_lineage(keys.join(refused, "root_id", "left_anti").select("key").distinct(), "gone") for name, keys in taken.items()}

    left = {}
    for table in order:
        df = getattr(t, table)
        if table in gone:
            left[table] = _without(df, plan.key(table), gone[table])
            continue
        for r in into(table):
            df = _without(df, r.column, gone[r.parent])
        left[table] = df
    return left, refused
