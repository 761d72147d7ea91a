"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Each source's documents, shuffled by a keyed hash, form one stream of words that is cut into
blocks of ``block`` words. Slot ``t`` of the mix has the golden-ratio point
``frac(t * 0.618...)``; the cumulative targets split the unit interval among the sources,
and the point's place names the slot's source. The slot's rank among its source's slots
names the block: the source's stream is read again from its start when it ends. A source
stops at its target, inside a block where need be. A source that the schedule has served too
few slots when it ends (its points may lag by a few) gets the rest in closing slots.

Ranks and offsets are counted in two steps, inside chunks and over the totals of chunks, so
a source with most of the rows is spread over many tasks.

NULL texts and texts without words have size 0 and are never taken. The NULL source is a
source like any other. Rows that repeat are each of them a document; identical ones are
interchangeable. Without any words all targets are 0. Equal places in a stream's order go by id, size and a hash of the
whole row. Long texts are counted where they are read; an empty table gives an empty result. In ``mixed`` all
columns of the input, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garbline.llm.common import WORD, absent_name, row_key, table
from garbline.llm.registry import query
from garbline.session import cut_lineage, discard_since, scratch_mark

BLOCK = 256
LIMIT = 3
SEED = 17
# Points are multiples of the golden section in steps of 2**-31; the multiplier is odd, so
# all 2**31 points differ before they repeat.
UNIT = 1 << 31
GOLDEN = 1327217885
CHUNK = 8192
CELLS = 4096
GROUP = 2_000


def sizes(docs: DataFrame) -> DataFrame:
    """``row`` (a key of all columns of the row), ``doc_id``, ``source`` and ``size``, the number of words; the text is not carried on."""
    return docs.select(row_key(*docs.columns).alias("row"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def shares(sized: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``source``, ``n`` (rows), ``source_size``, ``target``, ``words`` (the target in whole words) by source.

    All words are shared by the weights 1, 2, 3, 1, ... in the order of the sources. Where a
    share exceeds ``limit`` times the source's size, the source keeps that, and the excess is
    reshared until none is above: the sources are settled in the order in which a rising
    level per unit of weight reaches their limit. One row per source: small next to the data.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    listed = totals.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    rising = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    settled = listed.select(
        "*",
        F.coalesce(F.sum(F.col("source_size") * limit).over(before), F.lit(0)).alias("kept"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"),
        F.sum("source_size").over(every).alias("all_words"),
    )
    # a source is at its limit if the level, were it the next to be settled, is above it; the
    # first that is not gives the final level, the highest of those that are left
    level = (F.col("all_words") - F.col("kept")).cast("double") / F.col("open")
    full = level * F.col("weight") >= F.col("source_size") * limit
    levelled = settled.withColumn("level", F.max(F.when(~full, level)).over(every)).withColumn("full", full)
    target = F.when(F.col("full"), (F.col("source_size") * limit).cast("double")).otherwise(F.col("level") * F.col("weight"))
    return levelled.select("source", "n", "source_size", target.alias("target"), F.floor(target + 0.5).cast("bigint").alias("words"))


def _prefix(df: DataFrame, source: str, chunk: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same source that come before, chunk by chunk."""
    per_chunk = df.groupBy(source, chunk).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(source).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_chunk.select(
        F.col(source).alias("_of_source"), F.col(chunk).alias("_of_chunk"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy(source, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col(source).eqNullSafe(F.col("_of_source")) & (F.col(chunk) == F.col("_of_chunk"))
    return local.join(shifts, same).withColumn(name, F.col("_local") + F.col("_shift")).drop("_local", "_shift", "_of_source", "_of_chunk", chunk)


def streams(sized: DataFrame, seed: int = SEED, groups: int = 1) -> DataFrame:
    """Adds ``start``: the place of the document in its source's shuffled stream of words."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    keyed = sized.withColumn("_key", key).withColumn(
        "_group", F.expr("conv(substring(_key, 1, 8), 16, 10)").cast("bigint") % groups if groups > 1 else F.lit(0).cast("bigint")
    )
    # chunks are ordered by their number, so the stream's order is (chunk, key)
    return _prefix(keyed, "source", "_group", [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("row")], F.col("size"), "start").drop("_key")


def schedule(spark: SparkSession, shared: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """``slot``, ``source``, ``epoch``, ``block``, ``take``: what the mix reads, in order.

    ``shared`` is the result of ``shares``; ``total`` the number of words of all targets. Every
    source gets exactly its target, the last slot cut short.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    spans = shared.where(F.col("words") > 0).select(
        "*",
        F.expr(f"greatest(1, (source_size + {block - 1}) div {block})").alias("blocks"),
        F.sum("target").over(every).alias("_upto"),
        F.sum("target").over(Window.partitionBy()).alias("_sum"),
    )
    edge = lambda c: F.floor(c / F.col("_sum") * UNIT).cast("bigint")
    spans = spans.withColumn("high", edge(F.col("_upto"))).withColumn("low", F.coalesce(F.lag("high").over(every), F.lit(0)))
    # slots needed: whole passes over the stream, then blocks up to the target
    spans = spans.withColumn("slots", F.expr(f"(words div source_size) * blocks + (words % source_size + {block - 1}) div {block}")).drop(
        "_upto", "_sum", "target", "n"
    )
    cell = UNIT // CELLS
    by_cell = spans.select("*", F.explode(F.expr(f"sequence(low div {cell}, greatest(low, high - 1) div {cell})")).alias("cell"))
    n = total // block + 1
    points = spark.range(n).select(F.col("id").alias("slot"), F.expr(f"((id % {UNIT}) * {GOLDEN}) % {UNIT}").alias("point"))
    points = points.withColumn("cell", F.expr(f"point div {cell}"))
    placed = points.join(by_cell, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    chunked = placed.select("slot", "source", "source_size", "words", "blocks", "slots", F.expr(f"slot div {CHUNK}").alias("_chunk"))
    ranked = _prefix(chunked, "source", "_chunk", [F.col("slot")], F.lit(1).cast("bigint"), "rank")
    # closing slots, for sources that the schedule left short
    served = ranked.groupBy("source").agg(F.count("*").alias("_served"))
    short = spans.join(served.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").where(
        F.coalesce("_served", F.lit(0)) < F.col("slots")
    )
    closing = short.select(
        F.lit(n).cast("bigint").alias("slot"), "source", "source_size", "words", "blocks", "slots",
        F.explode(F.expr("sequence(coalesce(_served, 0L), slots - 1)")).alias("rank"),
    )
    slots = ranked.where(F.col("rank") < F.col("slots")).unionByName(closing)
    done = F.expr(f"(rank div blocks) * source_size + (rank % blocks) * {block}")
    take = F.least(F.lit(block), F.expr(f"source_size - (rank % blocks) * {block}"), F.col("words") - done)
    return slots.select(
        "slot", "source", F.expr("rank div blocks").alias("epoch"), F.expr("rank % blocks").alias("block"), take.alias("take")
    ).where(F.col("take") > 0)


def pieces(streamed: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``start``, and for each block that the document touches ``block``, ``first``, ``last``
    (places inside the block, the end excluded)."""
    touched = streamed.where(F.col("size") > 0).select(
        "*", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block")
    )
    return touched.select(
        "doc_id", "source", "size", "start", "block",
        F.expr(f"greatest(0, start - block * {block})").alias("first"),
        F.expr(f"least({block}, start + size - block * {block})").alias("last"),
    )


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs``: ``row``, ``doc_id``, ``source``, ``size``, ``start``, ``source_size``, ``target``, ``taken`` (words, repeats
    counted), ``passes`` (how often its first word is taken) and ``first_slot`` (NULL if never taken)."""
    spark = docs.sparkSession
    sized = cut_lineage(sizes(docs), "sizes")
    shared = cut_lineage(shares(sized, limit), "shares")
    counts = shared.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    groups = 1
    while groups * GROUP < (counts["n"] or 0):
        groups *= 2
    streamed = cut_lineage(streams(sized, seed, groups), "streams")
    planned = schedule(spark, shared, counts["words"] or 0, block).withColumnRenamed("source", "_source").withColumnRenamed("block", "_block")
    cut = pieces(streamed, block)
    same = cut["source"].eqNullSafe(F.col("_source")) & (cut["block"] == F.col("_block"))
    part = F.least("last", "take") - F.col("first")
    met = cut.join(planned, same).where(part > 0)
    begun = F.expr(f"block = start div {block}").cast("int")
    taken = met.groupBy(F.col("source").alias("_s"), F.col("start").alias("_at")).agg(
        F.sum(part).alias("taken"), F.sum(begun).alias("passes"), F.min("slot").alias("first_slot")
    )
    # places of documents with words are unique in a source; those without have no part
    here = streamed["source"].eqNullSafe(F.col("_s")) & (streamed["start"] == F.col("_at")) & (streamed["size"] > 0)
    named = shared.select(F.col("source").alias("_of"), "source_size", "target")
    return (
        streamed.join(taken, here, "left")
        .join(named, F.col("source").eqNullSafe(F.col("_of")))
        .select(
            "row", "doc_id", "source", "size", "start", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
            F.coalesce("passes", F.lit(0)).cast("int").alias("passes"),
            "first_slot",
        )
    )


# The same numbers by another route: the words that a source gives are the first ones of its
# stream read up to three times over.
ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR || ':{SEED}') AS k
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
-- the final level is the highest that any set of full sources would leave
level AS (
  SELECT max(((SELECT sum(s) FROM totals) - f.kept)::DOUBLE / f.still) AS lv
  FROM (SELECT a.source, coalesce(sum(3 * b.s) FILTER (b.s / b.w < a.s / a.w), 0)::BIGINT AS kept,
               sum(b.w) FILTER (b.s / b.w >= a.s / a.w)::BIGINT AS still
        FROM totals a, totals b GROUP BY a.source, a.s, a.w) f),
targets AS (SELECT source, s, least((3 * s)::DOUBLE, lv * w) AS target FROM totals, level),
grouped AS (
  SELECT *, ('0x' || left(k, 8))::BIGINT % (SELECT greatest(1, 2 ** ceil(log2(greatest(1, count(*)) / {GROUP}.0)))::BIGINT FROM documents) AS g
  FROM sized),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY g, k, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM grouped)
SELECT p.doc_id, p.size, t.s AS source_size, t.target,
       (greatest(0, least(p.size, floor(t.target + 0.5) - p.start))
      + greatest(0, least(p.size, floor(t.target + 0.5) - t.s - p.start))
      + greatest(0, least(p.size, floor(t.target + 0.5) - 2 * t.s - p.start)))::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""


@query("op1_mixing", ORACLE)
def op1_mixing(spark, sf_dir) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes its first word, zero to three times.

    Rows equal in all columns share what the mix takes of them.
    """
    mark = scratch_mark()
    plan = mix(docs)
    key, passes, rows, copy = (absent_name(docs, name) for name in ("row_key", "row_passes", "row_count", "row_copy"))
    often = plan.groupBy(F.col("row").alias(key)).agg(F.sum("passes").alias(passes), F.count("*").alias(rows))
    often = cut_lineage(often.where(F.col(passes) > 0), "often")
    discard_since(spark, mark)
    keyed = docs.withColumn(key, row_key(*docs.columns))
    single = keyed.join(often.where(F.col(rows) == 1), key)
    shared = keyed.join(often.where(F.col(rows) > 1), key).dropDuplicates([key])
    every = single.unionByName(shared).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(passes))))
    return every.select(*docs.columns)
