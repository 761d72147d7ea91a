"""Building blocks that keep hot keys and global orders off a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garbline.session import cut_lineage

CHUNK = 100_000


def join_spread_nulls(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    by: list[str] | None = None,
    how: str = "left",
    also: list[str] | None = None,
) -> DataFrame:
    """Left (or left anti) equi-join whose NULL keys are dealt out by ``by`` (all columns of the row).

    NULL matches nothing, but a plain shuffle sends all NULL rows to one task. A second
    join column, 0 for real keys on both sides and a hash of the row for NULL, spreads them
    over all tasks. The right side computes its 0 from the key so that it stays a join
    column. ``also`` are further equal columns, named alike on both sides.
    """
    dealt = F.when(F.col(left_key).isNull(), F.xxhash64(*(by or left.columns))).otherwise(F.lit(0))
    left_side = left.withColumn("_place", dealt.cast("bigint"))
    extra = also or []
    right_side = right.withColumn("_home", F.pmod(F.col(right_key), F.lit(1)).cast("bigint")).withColumnsRenamed(
        {c: f"_also_{c}" for c in extra}
    )
    matched = (left_side[left_key] == right_side[right_key]) & (left_side["_place"] == right_side["_home"])
    for c in extra:
        matched = matched & (left_side[c] == right_side[f"_also_{c}"])
    return left_side.join(right_side, matched, how).drop("_place", "_home", *[f"_also_{c}" for c in extra])


def join_reduced(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join to an aggregate on the same keys, safe for hot left keys.

    Adaptive execution splits a hot partition of ``left`` only if both sides come straight
    from a shuffle of their own, which an aggregate does not. So the aggregate is written
    out first; ``left`` is read once, and nothing is broadcast but by Spark's own estimate.
    """
    return left.join(cut_lineage(right, "reduced"), keys, how)


def number_rows(df: DataFrame, order: list[Column], name: str, start: int | Column = 1) -> DataFrame:
    """Dense row numbers in the given total order, without a one-task window.

    A range-partitioned sort places the rows, the placing is materialised, and each
    partition is shifted by the sizes of those before it. The offsets relation has one
    row per sort partition, which bounds both its window and its broadcast.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn(
        "_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_pos") + F.col("_offset") + first).cast("bigint"))
        .drop("_at", "_part", "_pos", "_offset")
    )


def place_in_group(df: DataFrame, key: str, order: list[str], name: str, cuts: int = 16, sample: int = 1024) -> DataFrame:
    """Add the position (from 0) of each row among those of its ``key``, in the order of ``order``.

    A few cut points in that order, from a sample of ``sample`` rows chosen by hash (which the driver
    sees), divide every group into cells; rows are numbered within key and cell and shifted by the sizes of the cells before. A hot
    group is thus sorted in as many tasks as it has cells; nothing is sorted as a whole or written.
    Rows without a key are left out.
    """
    named = df.where(F.col(key).isNotNull())
    kinds = dict(named.dtypes)
    some = named.select(*order).orderBy(F.xxhash64(*order)).limit(sample).orderBy(*order)
    texts = some.select(*[F.col(c).cast("string").alias(c) for c in order]).collect()
    step = max(1, len(texts) // cuts)
    cell = F.lit(0)
    for point in texts[step - 1 :: step]:
        bound = F.struct(*[F.lit(point[c]).cast(kinds[c]).alias(c) for c in order])
        cell = cell + (bound < F.struct(*order)).cast("int")
    cells = named.withColumn("_cell", cell)
    sizes = cells.groupBy(key, "_cell").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(key, "_cell", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy(key, "_cell").orderBy(*order)) - 1
    numbered = cells.withColumn("_within", within).join(shifts, [key, "_cell"])
    return numbered.withColumn(name, (F.col("_within") + F.col("_shift")).cast("bigint")).drop("_cell", "_within", "_shift")


def sum_before(df: DataFrame, key: str, rank: str, sums: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """Running sums of the rows of the same ``key`` with a smaller ``rank``.

    ``rank`` is dense and occurs once per key, so a chunk of ranks bounds every window:
    chunk totals are prefix-summed per key, then rows within their chunk.
    """
    slots = df.withColumn("_slot", F.floor(F.col(rank) / F.lit(chunk)))
    per_slot = slots.groupBy(key, "_slot").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_slot.select(
        key, "_slot", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(key, "_slot").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    within = slots.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{n}") for n, c in sums.items()]
    )
    joined = within.join(shifts, [key, "_slot"])
    return joined.select(
        *df.columns, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    )
