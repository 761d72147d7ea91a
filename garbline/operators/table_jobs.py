"""Upserts, loads, toggles, updates and deletes as set operations on whole tables."""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garbline.functions.first_come import FOLD, first_come
from garbline.functions.spread import join_reduced, number_rows
from garbline.functions.text import is_digits
from garbline.schemas import ROLE_PACKER
from garbline.session import cut_lineage


def next_id(df: DataFrame, key: str = "id") -> Column:
    """One more than the largest key, as a scalar subquery."""
    return (F.coalesce(df.agg(F.max(key)).scalar(), F.lit(0)) + 1).cast("bigint")


def receive_stock(skus: DataFrame, receipts: DataFrame, digits_only: bool = True) -> DataFrame:
    """SKUs with ``receipts`` (product_size_id, amount as text) added.

    One path takes digit strings only and ignores the rest; the other takes any whole
    number, negative ones too.
    """
    amount = F.expr("try_cast(amount AS BIGINT)")
    valid = receipts.where(is_digits(F.col("amount"))) if digits_only else receipts.where(amount.isNotNull())
    sums = valid.groupBy(F.col("product_size_id").alias("id")).agg(F.sum(amount).alias("_in"))
    return skus.join(sums, "id", "left").withColumn(
        "stock", (F.col("stock") + F.coalesce("_in", F.lit(0))).cast("bigint")
    ).drop("_in")


def merge_sizes(sizes: DataFrame, changes: DataFrame) -> DataFrame:
    """Worker sizes after ``changes`` (seq, team_member_id, product_type, size).

    The last change of a key wins; an empty size removes the row.
    """
    key = ["team_member_id", "product_type"]
    last = changes.groupBy(*key).agg(F.max_by(F.trim(F.coalesce("size", F.lit(""))), "seq").alias("size"))
    kept = sizes.join(last, key, "left_anti")
    return kept.unionByName(last.where(F.col("size") != "").select(*key, "size"))


DELEGATION_KEY = ["from_supervisor_id", "to_supervisor_id", "start_date", "end_date"]


def insert_delegations(delegations: DataFrame, inserts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows, refused): an exact copy of an existing delegation is refused.

    ``inserts``: seq and the four columns. Of equal inserts in the batch the first counts.
    """
    ranked = inserts.groupBy(*DELEGATION_KEY).agg(F.min("seq").alias("seq"))
    news = ranked.join(delegations, DELEGATION_KEY, "left_anti")
    refused = inserts.join(news.select("seq"), "seq", "left_anti")
    return number_rows(news, [F.col("seq").asc()], "id", next_id(delegations)).drop("seq"), refused


def maintain_delegations(delegations: DataFrame, commands: DataFrame) -> DataFrame:
    """End-date changes and removals (seq, actor_id, action, delegation_id, end_date), by the owner only."""
    owned = commands.withColumnRenamed("delegation_id", "id").join(
        delegations.select("id", F.col("from_supervisor_id").alias("actor_id")), ["id", "actor_id"], "left_semi"
    )
    changes = owned.groupBy("id").agg(
        F.bool_or(F.col("action") == "delete").alias("_gone"),
        F.max_by(F.when(F.col("action") == "extend", F.col("end_date")),
                 F.when(F.col("action") == "extend", F.col("seq"))).alias("_end"),
    )
    return (
        delegations.join(changes, "id", "left")
        .where(~F.coalesce("_gone", F.lit(False)))
        .withColumn("end_date", F.coalesce("_end", "end_date"))
        .select(*delegations.columns)
    )


def merge_delegations(
    delegations: DataFrame, commands: DataFrame, inserts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(delegations, refused inserts) after a batch of commands and inserts, one after the other by ``seq``.

    An insert is refused while an exact copy exists: a delegation with these dates at that
    point of the batch, or an earlier accepted insert.
    """
    owned = commands.withColumnRenamed("delegation_id", "id").join(
        delegations.select("id", F.col("from_supervisor_id").alias("actor_id")), ["id", "actor_id"], "left_semi"
    )
    # Each delegation as it stands between its changes: from one seq up to the next.
    never = F.lit(-(1 << 62))
    states = delegations.select(*DELEGATION_KEY, "id", never.alias("since"), F.lit(False).alias("gone")).unionByName(
        owned.where(F.col("action").isin("delete", "extend"))
        .join(delegations.select("id", *DELEGATION_KEY[:3]), "id")
        .select(*DELEGATION_KEY[:3], "end_date", "id", F.col("seq").alias("since"), (F.col("action") == "delete").alias("gone"))
    )
    later = Window.partitionBy("id").orderBy("since")
    so_far = later.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    states = states.withColumns(
        {"until": F.coalesce(F.lead("since").over(later), F.lit(1 << 62)), "over": F.max("gone").over(so_far)}
    ).where(~F.col("over"))
    standing = states.select(*DELEGATION_KEY, "since", "until")
    meets = (F.col("seq") >= F.col("since")) & (F.col("seq") < F.col("until"))
    tested = inserts.join(standing, DELEGATION_KEY, "left").groupBy("seq", *DELEGATION_KEY).agg(
        F.bool_or(F.coalesce(meets, F.lit(False))).alias("blocked")
    )
    first = tested.where(~F.col("blocked")).groupBy(*DELEGATION_KEY).agg(F.min("seq").alias("seq"))
    refused = inserts.join(first.select("seq"), "seq", "left_anti")
    news = number_rows(first, [F.col("seq").asc()], "id", next_id(delegations)).drop("seq")
    return maintain_delegations(delegations, commands).unionByName(news.select(*delegations.columns)), refused


def toggle_state(clicks: DataFrame, keys: list[str], base: DataFrame | None = None) -> DataFrame:
    """Keys that are on: an odd number of clicks, counting one for keys that were on before."""
    rows = clicks.select(*keys) if base is None else clicks.select(*keys).union(base.select(*keys))
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") % 2 == 1).drop("_n")


def toggle_pins(posts: DataFrame, clicks: DataFrame) -> DataFrame:
    """Posts with ``pinned`` flipped once per click (``post_id``); NULL counts as 0."""
    flips = clicks.groupBy(F.col("post_id").alias("id")).agg((F.count("*") % 2 == 1).alias("_flip"))
    pinned = F.coalesce((F.col("pinned") != 0).cast("int"), F.lit(0))
    value = F.when(F.col("_flip").isNull(), F.col("pinned")).when(F.col("_flip"), 1 - pinned).otherwise(pinned)
    return posts.join(flips, "id", "left").withColumn("pinned", value).select(*posts.columns)


def first_seen(marks: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Insert-if-absent log: each key once, with its first time."""
    return marks.groupBy(*keys).agg(F.min(ts).alias("first_seen"))


def unpivot_sizes(incoming: DataFrame, ids: list[str]) -> DataFrame:
    """SKU rows from wide ``size_<x>`` columns of text; empty is 0, NULL means the size was not given.

    ``stock`` is NULL where the text is no whole number (see ``with_bad_sizes``).
    """
    columns = [c for c in incoming.columns if c.startswith("size_")]
    long = incoming.unpivot(ids, columns, "size", "amount").where(F.col("amount").isNotNull())
    return long.select(
        *ids,
        F.replace("size", F.lit("size_"), F.lit("")).alias("size"),
        F.when(F.trim("amount") == "", 0).otherwise(F.expr("try_cast(trim(amount) AS BIGINT)")).cast("bigint").alias("stock"),
    )


def with_bad_sizes(incoming: DataFrame) -> DataFrame:
    """Add ``bad_size``: whether any size text of the row is neither empty nor a whole number."""
    bad = F.lit(False)
    for c in (c for c in incoming.columns if c.startswith("size_")):
        text = F.trim(c)
        bad = bad | (text.isNotNull() & (text != "") & text.try_cast("bigint").isNull())
    return incoming.withColumn("bad_size", bad)


def accept_first(incoming: DataFrame, seq: str, keys: list[str], seen: list | None = None, fold: int = FOLD) -> DataFrame:
    """Add ``accepted``: process rows by ``seq``, refusing one that shares any key with an accepted row.

    Every value of a key is a resource of which there is one, and a row claims one of each of its keys, so
    ``first_come`` matches rows to key values. NULL is no value. Only values that several rows share
    are contested; a row without any is accepted.
    """
    values = incoming.select(seq, F.explode(F.array(*[F.struct(F.lit(i).alias("key"), F.col(k).cast("string").alias("value")) for i, k in enumerate(keys)])).alias("resource"))
    values = values.where("resource.value is not null").select(seq, "resource.key", "resource.value")
    shared = cut_lineage(values.groupBy("key", "value").agg(F.count("*").alias("n")).where("n > 1").select("key", "value"))
    claims = cut_lineage(values.join(shared, ["key", "value"]).select(seq, F.struct("key", "value").alias("resource")))
    ranked = cut_lineage(number_rows(claims.select(seq).distinct(), [F.col(seq).asc()], "rank", 0).select(seq, "rank"))
    lost = first_come(claims.join(ranked, seq).select("rank", "resource", F.lit(1).alias("need"), F.lit(1).alias("stock")), fold=fold, seen=seen)
    refused = ranked.join(lost, "rank").select(seq, F.lit(True).alias("_lost"))
    return incoming.join(refused, seq, "left").withColumn("accepted", F.col("_lost").isNull()).drop("_lost")


def load_products(base: DataFrame, incoming: DataFrame) -> SimpleNamespace:
    """Load products: ``products``, ``skus``, ``links`` and ``rejects``.

    ``incoming``: seq, article_number, name, type, price, job_role_ids (array) and wide
    ``size_<x>`` text columns. A name or article number already present, in the base or in
    an earlier accepted row, refuses the row; the name is tested first. A size text that is no
    whole number refuses its row before all else, and so blocks no other.
    """
    rows = with_bad_sizes(incoming).withColumns(
        {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("article_number", "name")}
    )
    for key in ("name", "article_number"):
        taken = base.select(key, F.lit(True).alias(f"_base_{key}")).distinct()
        rows = join_reduced(rows, taken, [key], "left")
    in_base = F.coalesce("_base_name", "_base_article_number").isNotNull()
    fresh = accept_first(rows.where(~in_base & ~F.col("bad_size")), "seq", ["name", "article_number"])
    won = fresh.where("accepted").drop("accepted", "bad_size")
    # Accepted names are unique, so this join keeps the rows as they are.
    namesakes = won.select("name", F.col("seq").alias("_by"))
    refused = rows.join(won.select("seq"), "seq", "left_anti").join(namesakes, "name", "left")
    same_name = F.col("_base_name").isNotNull() | F.coalesce(F.col("_by") < F.col("seq"), F.lit(False))
    rejects = refused.select(
        "seq",
        "name",
        "article_number",
        F.when(F.col("bad_size"), "invalid size amount")
        .when(same_name, "name exists")
        .otherwise("article number exists")
        .alias("reason"),
    )
    numeric = dict(base.dtypes)["id"] != "string"
    start = next_id(base) if numeric else F.lit(1)
    numbered = number_rows(won, [F.col("seq").asc()], "id", start)
    products = numbered.select("id", "article_number", "name", "type", "price")
    skus = unpivot_sizes(numbered.withColumnRenamed("id", "product_id"), ["product_id"])
    links = numbered.select(F.col("id").alias("product_id"), F.explode("job_role_ids").alias("job_role_id"))
    return SimpleNamespace(products=products, skus=skus, links=links, rejects=rejects)


def load_users(base: DataFrame, incoming: DataFrame, roles: DataFrame) -> SimpleNamespace:
    """Load users: ``users``, ``user_sites`` and ``rejects``.

    ``incoming``: seq, full_name, email, system_role, job_role_id, supervisor_id,
    facility_id, site_ids (array). A packer gets the role named Packer, if there is one. An
    e-mail already present, in the base or earlier in the batch, refuses the row.
    """
    first = incoming.groupBy("email").agg(F.min("seq").alias("seq"))
    free = first.join(base.select("email"), "email", "left_anti")
    accepted = incoming.join(free.select("seq"), "seq", "left_semi")
    rejects = incoming.join(free.select("seq"), "seq", "left_anti").select(
        "seq", "email", F.lit("email exists").alias("reason")
    )
    packer_role = roles.where(F.col("name") == ROLE_PACKER).agg(F.min("id")).scalar()
    role = F.when(F.col("system_role") == "packer", F.coalesce(packer_role, "job_role_id")).otherwise(
        F.col("job_role_id")
    )
    numbered = number_rows(
        accepted.withColumn("job_role_id", role), [F.col("seq").asc()], "id", next_id(base)
    )
    users = numbered.select(
        "id", "full_name", "email", "system_role", "job_role_id", "supervisor_id", "facility_id"
    )
    sites = numbered.select(F.col("id").alias("user_id"), F.explode("site_ids").alias("site_id")).distinct()
    return SimpleNamespace(users=users, user_sites=sites, rejects=rejects)


def guard_user_deletes(users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users to delete as ``user_id``, refused) for ``requests``: seq, actor_id, user_id.

    Refused: deleting yourself, unknown users, and the last admin. Admins go in order of
    their first valid request, so only the last can be refused, and only if all are asked for.
    """
    people = users.select(F.col("id").alias("user_id"), "system_role")
    valid = (
        requests.where(F.col("actor_id") != F.col("user_id"))
        .groupBy("user_id")
        .agg(F.min("seq").alias("seq"))
        .join(people, "user_id")
    )
    admins = valid.where(F.col("system_role") == "admin")
    asked = admins.agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    total = users.where(F.col("system_role") == "admin").agg(F.count("*")).scalar()
    keep_one = (
        (F.col("system_role") == "admin")
        & (asked.select("n").scalar() >= total)
        & (F.col("seq") == asked.select("last").scalar())
    )
    doomed = valid.where(~keep_one).select("user_id")
    return doomed, requests.join(doomed, "user_id", "left_anti")


def unreferenced(dim: DataFrame, refs: list[tuple[DataFrame, str]]) -> DataFrame:
    """Dimension rows that no reference column points to, and so may be deleted."""
    for df, column in refs:
        dim = dim.join(df.select(F.col(column).alias("id")), "id", "left_anti")
    return dim


def apply_updates(
    base: DataFrame, changes: DataFrame, key: str, only_if: str | None = None, blank_is_null: tuple[str, ...] = ()
) -> DataFrame:
    """``base`` with the columns of ``changes`` (one row per key) written over it, NULL too.

    A change whose ``only_if`` column is NULL or blank changes nothing at all. Texts are
    written without outer blanks; in ``blank_is_null`` columns an empty one becomes NULL.
    """
    written = [c for c in changes.columns if c != key]
    if only_if is not None:
        changes = changes.where(F.trim(F.coalesce(only_if, F.lit(""))) != "")
    value = {c: F.trim(c) if dict(changes.dtypes)[c] == "string" else F.col(c) for c in written}
    value |= {c: F.nullif(value[c], F.lit("")) for c in blank_is_null}
    fresh = changes.select(key, *[value[c].alias(f"_{c}") for c in written], F.lit(True).alias("_hit"))
    columns = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in written}
    return base.join(fresh, key, "left").withColumns(columns).select(*base.columns)


def apply_deletes(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``base`` without the rows whose ``on`` columns are among the keys (key, or key and scope)."""
    return base.join(keys.select(*on), on, "left_anti")


def append_rows(base: DataFrame, rows: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """``base`` plus ``rows`` with generated keys, dense and in the given order."""
    numbered = number_rows(rows, [F.col(c).asc() for c in order], key, next_id(base, key))
    return base.unionByName(numbered.select(*[c for c in base.columns if c in numbered.columns]), allowMissingColumns=True)
