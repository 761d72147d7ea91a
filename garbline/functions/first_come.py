"""All-or-nothing claims on limited resources, first come first served, for many claimants at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garbline.functions.graph import components
from garbline.functions.spread import CHUNK, sum_before
from garbline.session import cut_and_count, cut_lineage, discard_since, scratch_mark, scratch_path

# Rows of one group that are decided in order inside a task.
FOLD = 4096

# Walks the claimants of a group in order: what is left of each resource, and who went away empty.
_SHORT = "exists(c.lines, l -> l.need > acc.left[l.at])"
_WALK = f"""
aggregate(claimants,
  named_struct('left', left, 'lost', CAST(array() AS ARRAY<BIGINT>)),
  (acc, c) -> named_struct(
    'left', IF({_SHORT}, acc.left, transform(acc.left, (x, i) -> x - aggregate(filter(c.lines, l -> l.at = i), 0L, (s, l) -> s + l.need))),
    'lost', IF({_SHORT}, concat(acc.lost, array(c.rank)), acc.lost)),
  acc -> acc.lost)
"""


def walked(rows: DataFrame) -> DataFrame:
    """(rank, accepted) for ``rows`` (component, rank, resource, need, stock), each component in order.

    A component's resources become places of an array, so a step costs no lookup by name. The
    size of a component is bounded by the caller.
    """
    place = F.dense_rank().over(Window.partitionBy("component").orderBy("resource")) - 1
    lines = rows.withColumn("at", place).groupBy("component", "rank").agg(F.collect_list(F.struct("at", "need", "stock")).alias("lines"))
    groups = lines.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("rank", "lines"))).alias("claimants"))
    stocks = "array_sort(array_distinct(flatten(transform(claimants, c -> transform(c.lines, l -> named_struct('at', l.at, 'stock', l.stock))))))"
    lost = groups.withColumn("left", F.expr(f"transform({stocks}, s -> s.stock)")).withColumn("lost", F.expr(_WALK))
    told = F.expr("transform(claimants, c -> named_struct('rank', c.rank, 'accepted', NOT array_contains(lost, c.rank)))")
    return lost.select(F.explode(told).alias("x")).select("x.rank", "x.accepted")


def behind_one(verdicts: DataFrame) -> DataFrame:
    """(rank, accepted) of claimants that wait for one other, which waits for one other, and so on to a decided one.

    ``verdicts``: rank, accepted (NULL while open), blocker. A claimant is accepted if
    and only if its blocker is not, so a chain alternates. Pointers are doubled: a chain of n takes
    log2(n) rounds.
    """
    hops, moved = cut_and_count(verdicts.where("blocker is not null").select("rank", F.col("blocker").alias("root"), F.lit(True).alias("odd")), "hops")
    if not moved:
        return verdicts.select("rank", "accepted").limit(0)
    while moved:
        ahead = hops.select(F.col("rank").alias("root"), F.col("root").alias("next"), F.col("odd").alias("next_odd"))
        jumped = hops.join(ahead, "root", "left").select(
            "rank", F.coalesce("next", "root").alias("root"), (F.col("odd") != F.coalesce("next_odd", F.lit(False))).alias("odd"), F.col("next").isNotNull().alias("moved")
        )
        jumped, n = cut_and_count(jumped, "hops")
        hops = jumped.drop("moved")
        moved = n and jumped.where("moved").head(1)
    roots = verdicts.where("accepted is not null").select(F.col("rank").alias("root"), "accepted")
    return hops.join(roots, "root").select("rank", (F.col("accepted") != F.col("odd")).alias("accepted"))


def _without(state: DataFrame, decided: DataFrame) -> tuple[DataFrame, int]:
    """What stays open: accepted claims leave the stock, and resources that now suffice for all leave too."""
    told = state.join(decided, "rank", "left")
    is_open = F.col("accepted").isNull()
    left = cut_lineage(
        told.groupBy("resource")
        .agg(
            (F.max("stock") - F.coalesce(F.sum(F.when(F.col("accepted"), F.col("need"))), F.lit(0))).cast("bigint").alias("stock"),
            F.sum(F.when(is_open, F.col("need"))).alias("wanted"),
        )
        .where("wanted > stock")
        .select("resource", "stock"),
        "left",
    )
    return cut_and_count(told.where(is_open).drop("stock", "accepted").join(left, "resource"), "open")


def first_come(claims: DataFrame, chunk: int = CHUNK, fold: int = FOLD, seen: list | None = None) -> DataFrame:
    """The claimants (``rank``) that go away empty.

    ``claims``: rank (dense, in order of arrival), resource, need, stock (of the resource); one row for
    each rank and resource. A claimant takes all it needs or, if any resource no longer suffices, nothing.
    While more than ``fold`` rows are open, they are decided together, in three ways:

    * by sums: who needs more than is left loses; who fits even if all earlier open ones are served
      is accepted;
    * by chains: who fits unless one certain earlier claimant is accepted gets the opposite
      of that one's fate, along chains of any length by doubling;
    * by components of claimants that meet at a resource: small ones are walked in order, each in one
      task. Of large ones the first claimants are, as many as ``fold`` rows hold, for no one earlier is left out.

    Then resources that suffice for what is still open leave, and components fall apart. The first
    way always decides the earliest, the third as many as a task can walk, so rounds are
    bounded by the rows of the largest component over ``fold``; in practice a few. The last
    ``fold`` rows are walked as one. ``seen`` collects the open rows of each round.
    """
    spark = claims.sparkSession
    state, rows = cut_and_count(claims.select("rank", "resource", F.col("need").cast("bigint").alias("need"), F.col("stock").cast("bigint").alias("stock")), "open")
    kind = dict(state.dtypes)["rank"]
    lost, turn = scratch_path(spark, "lost"), 0

    def note(decided: DataFrame) -> None:
        nonlocal turn
        decided.where("not accepted").select("rank").write.parquet(f"{lost}/turn={turn}")
        turn += 1

    while rows:
        if seen is not None:
            seen.append(rows)
        if rows <= fold:
            note(walked(state.withColumn("component", F.lit(0))))
            break
        mark = scratch_mark()
        tested = sum_before(state, "resource", "rank", {"before": F.col("need"), "earlier": F.lit(1), "who": F.col("rank")}, chunk)
        fits = F.col("before") + F.col("need") <= F.col("stock")
        waits = F.when(~fits, F.when(F.col("earlier") == 1, F.col("who")).otherwise(F.lit(-1)))
        verdicts = tested.groupBy("rank").agg(
            F.bool_or(F.col("need") > F.col("stock")).alias("fails"), F.bool_and(fits).alias("fits"), F.min(waits).alias("low"), F.max(waits).alias("high")
        )
        verdicts = verdicts.select(
            "rank",
            F.when(F.col("fails"), False).when(F.col("fits"), True).alias("accepted"),
            F.when(~F.col("fails") & (F.col("low") == F.col("high")) & (F.col("low") >= 0), F.col("low")).alias("blocker"),
        ).where("accepted is not null or blocker is not null")
        verdicts = cut_lineage(verdicts, "verdicts")
        decided = cut_lineage(verdicts.where("accepted is not null").select("rank", "accepted").unionByName(behind_one(verdicts)), "decided")
        note(decided)
        state, rows = _without(state, decided)
        if rows > fold:
            leads = cut_lineage(state.groupBy("resource").agg(F.min("rank").alias("lead")), "leads")
            roots = cut_lineage(components(state.join(leads, "resource").select(F.col("rank").alias("a"), F.col("lead").alias("b"))), "roots")
            named = cut_lineage(
                state.join(roots.withColumnRenamed("node", "rank"), "rank", "left").withColumn("component", F.coalesce("root", "rank")).drop("root"), "named"
            )
            # The first claimants of each component; those of small ones are all.
            each = named.groupBy("component", "rank").agg(F.count("*").alias("lines"))
            order = Window.partitionBy("component").orderBy("rank")
            first = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= fold)
            first = first.withColumn("rows", F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("rows") <= fold)
            decided = cut_lineage(walked(named.join(cut_lineage(first.select("rank"), "first"), "rank", "left_semi")), "decided")
            note(decided)
            state, rows = _without(state, decided)
        discard_since(spark, mark)
    if not turn:
        return claims.select("rank").limit(0)
    return spark.read.schema(f"rank {kind}, turn INT").parquet(lost).select("rank")
