"""Document fingerprints by SimHash, with DataFrame functions only.

Terms are pairs of neighbouring lower-case words (the last word stands alone). Each term's
hash votes on every bit of the fingerprint, up or down, with the length of its first word
(at most 8) as weight; the sign of the sum is the bit. Two bit counters share one long sum, so
a document needs 64 sums for 128 bits, kept inside one aggregation whose partial sums are
taken before any shuffle.

All fingerprints within a Hamming radius ``r`` are found with a table for each of four blocks
of the bits. ``r + 1`` is dealt out to the blocks as evenly as it goes; two fingerprints that
differ in ``r`` bits differ in fewer than its share in one block at least, so a query asks
each table for its own block and for those with fewer than the share of bits turned. Equal
fingerprints are one row of the tables, with the number of their documents.

``n_within`` counts at radius 3, where little but equal texts and long ones with a changed
word are found; ``n_near`` at ``NEAR``, where near copies of usual length are.

Every row of the input is a row of the result. NULL text counts as empty; a text without words has no votes
and the fingerprint 0. Different texts of one id follow each other by a hash of the text; rows equal in id
and text are one document, returned as often as it occurs. A row without an id has a fingerprint of its own
and no next document: what depends on that is NULL. Words of long texts are counted inside one task and leave
it as sums. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garbline.llm.common import table
from garbline.llm.registry import query
from garbline.session import cut_lineage, discard_since, scratch_mark

BITS = 128
RADIUS = 3
# Of 30 random texts of 100 words with one changed, 27 are found (2 at RADIUS); of 200 words with two, 27 (1);
# of 500 words with three, all (3).
NEAR = 11
BLOCK = 32
_PAIR = 0x0000000100000001


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def fingerprint(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``high``, ``low``: the two halves of the fingerprint of each row's text.

    ``keys`` must tell rows apart. One aggregation; no shuffle beyond that of its keys.
    """
    tokens = df.select(*keys, words(F.col(text)).alias("_w"))
    # a text without words keeps one row without a vote
    terms = tokens.select(*keys, "_w", F.posexplode_outer("_w").alias("_at", "_one"))
    after = F.get("_w", F.col("_at") + 1)
    weight = F.when(F.col("_one").isNull(), 0).otherwise(F.least(F.length("_one"), F.lit(8))).cast("bigint")
    hashed = terms.select(
        *keys,
        weight.alias("_weight"),
        *[F.xxhash64("_one", after, F.lit(half)).alias(f"_h{half}") for half in (0, 1)],
    )
    votes = hashed.groupBy(*keys).agg(
        F.sum("_weight").alias("_all"),
        *[
            F.sum(F.col("_weight") * F.shiftrightunsigned(f"_h{half}", bit).bitwiseAND(F.lit(_PAIR))).alias(f"_s{half}_{bit}")
            for half in (0, 1)
            for bit in range(32)
        ],
    )

    def bits(half: int) -> Column:
        def one(bit: int) -> Column:
            both = F.col(f"_s{half}_{bit % 32}")
            ups = F.shiftrightunsigned(both, 32) if bit >= 32 else both.bitwiseAND(F.lit(0xFFFFFFFF))
            return F.when(ups * 2 > F.col("_all"), F.shiftleft(F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint"))

        return reduce(lambda a, b: a.bitwiseOR(b), [one(bit) for bit in range(64)])

    return votes.select(*keys, bits(0).alias("high"), bits(1).alias("low"))


def spelled(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def distance(high: Column, low: Column, other_high: Column, other_low: Column) -> Column:
    return F.bit_count(high.bitwiseXOR(other_high)) + F.bit_count(low.bitwiseXOR(other_low))


def likeness(*halves: Column) -> Column:
    return (F.lit(1.0) - distance(*halves) / F.lit(float(BITS))).cast("double")


def turned(fewer: int) -> list[int]:
    """All blocks with fewer than ``fewer`` bits set."""
    return [sum(1 << bit for bit in bits) for k in range(fewer) for bits in combinations(range(BLOCK), k)]


def within(fingerprints: DataFrame, queries: DataFrame, radius: int = RADIUS, near: int | None = None) -> DataFrame:
    """For each row of ``queries`` (``id``, ``high``, ``low``): ``id`` and ``n_within``, the number of other
    rows of ``fingerprints`` (``high``, ``low``) at a distance of ``radius`` or less, and ``n_near``,
    those at ``near`` or less, if that (a larger radius) is given.

    A query must itself be among the fingerprints. Both sides are reduced to different
    fingerprints before they meet, so copies cost nothing. The queries are multiplied by the
    blocks that they ask for, the fingerprints only by the number of blocks.
    """
    widest = radius if near is None else near
    parts = BITS // BLOCK
    share = [(widest + 1 + i) // parts for i in range(parts)]
    used = [i for i in range(parts) if share[i]]
    halves = [F.shiftrightunsigned("high", BLOCK), F.col("high"), F.shiftrightunsigned("low", BLOCK), F.col("low")]

    def tables(df: DataFrame) -> DataFrame:
        blocks = [F.struct(F.lit(i).alias("part"), halves[i].bitwiseAND(F.lit(0xFFFFFFFF)).alias("block")) for i in used]
        return df.select("*", F.explode(F.array(*blocks)).alias("t")).select("*", "t.part", "t.block").drop("t")

    stored = tables(fingerprints.groupBy("high", "low").agg(F.count("*").alias("copies"))).select(
        "part", "block", F.col("high").alias("to_high"), F.col("low").alias("to_low"), "copies"
    )
    masks = {fewer: F.split(F.lit(",".join(map(str, turned(fewer)))), ",").cast("array<bigint>") for fewer in {share[i] for i in used}}
    wanted = reduce(lambda a, i: F.when(F.col("part") == i, masks[share[i]]).otherwise(a), used[1:], masks[share[used[0]]])
    asked = tables(queries.select("high", "low").distinct()).withColumn("_turn", F.explode(wanted))
    asked = asked.select("high", "low", "part", F.col("block").bitwiseXOR(F.col("_turn")).alias("block"))
    apart = distance(F.col("high"), F.col("low"), F.col("to_high"), F.col("to_low"))
    # the blocks asked for compress well, but are too many to be sent to every task
    met = asked.hint("merge").join(stored, ["part", "block"]).where(apart <= widest)
    once = met.select("high", "low", "to_high", "to_low", "copies", apart.alias("apart")).distinct()
    counts = {"n_within": radius} | ({} if near is None else {"n_near": near})
    totals = once.groupBy("high", "low").agg(*[F.sum(F.when(F.col("apart") <= r, F.col("copies"))).alias(n) for n, r in counts.items()])
    return queries.join(totals, ["high", "low"]).select("id", *[(F.col(n) - 1).alias(n) for n in counts])


def successors(ids: DataFrame) -> DataFrame:
    """``doc_id``, ``key``, ``next_id``, ``next_key``, ``half`` for the different pairs of ``ids``, in ascending order; the last
    is followed by the first.

    The sorted pairs are written with the number of their range, so that each looks for the
    next in its own range and only the first pairs of the ranges meet in one place.
    """
    placed = cut_lineage(
        ids.repartitionByRange("doc_id", "key").select("doc_id", "key", "half", F.spark_partition_id().alias("range")), "order"
    )
    pair = F.struct("doc_id", "key")
    ranges = placed.groupBy("range").agg(F.min(pair).alias("first"))
    order = Window.orderBy("range")
    following = ranges.select(
        "range", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("after")
    )
    inside = placed.withColumn("next", F.lead(pair).over(Window.partitionBy("range").orderBy("doc_id", "key")))
    found = inside.join(following, "range").withColumn("next", F.coalesce("next", "after"))
    return found.select("doc_id", "key", F.col("next.doc_id").alias("next_id"), F.col("next.key").alias("next_key"), "half")


def edited_texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (of the text), ``copies``, ``next_id``, ``next_key``, ``n_chars``, ``text``, ``edited``: the second half of each
    text replaced by as many code points from the start of the next document's.

    Rows equal in id and text are one, with the number of their ``copies``. Texts of one id follow each other
    by ``key``. Rows without an id have no next document, and NULL as edited text.
    """
    text = F.coalesce("text", F.lit(""))
    known = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"))
    named = known.where("doc_id is not null")
    # Read on both sides of a join with the same columns and conditions, so that texts are shuffled once.
    whole = named.groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    # texts are not needed for the order
    ids = named.groupBy("doc_id", "key").agg(F.expr("cast(min(length(text)) div 2 as int)").alias("half"))
    order = cut_lineage(successors(ids), "successors")
    asked = order.select(
        F.col("next_id").alias("doc_id"), F.col("next_key").alias("key"), F.col("doc_id").alias("before"), F.col("key").alias("before_key"), F.col("half").alias("wanted")
    )
    given = whole.where("copies > 0").join(asked, ["doc_id", "key"]).select(
        F.col("before").alias("doc_id"), F.col("before_key").alias("key"), F.expr("substring(text, 1, wanted)").alias("given")
    )
    size = F.length("text").cast("bigint").alias("n_chars")
    followed = (
        whole.join(given, ["doc_id", "key"])
        .join(order.drop("half"), ["doc_id", "key"])
        .select(
            "doc_id",
            "key",
            "copies",
            "next_id",
            "next_key",
            size,
            "text",
            F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), "given").alias("edited"),
        )
    )
    alone = known.where("doc_id is null").groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    nothing = F.lit(None)
    return followed.unionByName(
        alone.select(
            "doc_id", "key", "copies", nothing.cast(known.schema["doc_id"].dataType).alias("next_id"), nothing.cast("bigint").alias("next_key"), size, "text",
            nothing.cast("string").alias("edited"),
        )
    )


@query("op9_fingerprints")
def op9_fingerprints(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    mark = scratch_mark()
    row = ["doc_id", "key", "copies", "next_id", "next_key", "n_chars", "edited_sha256"]
    both = edited_texts(docs).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(
        *row,
        F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("body")))).alias("v"),
    )
    prints = fingerprint(both.select(*row, "v.version", "v.body"), [*row, "version"], "body")
    side = lambda n, half: F.max(F.when(F.col("version") == n, F.col(half)))
    prints = cut_lineage(
        prints.groupBy(*row).agg(
            side(0, "high").alias("high"), side(0, "low").alias("low"), side(1, "high").alias("e_high"), side(1, "low").alias("e_low")
        ),
        "fingerprints",
    )
    discard_since(spark, mark)
    following = prints.select(F.col("doc_id").alias("next_id"), F.col("key").alias("next_key"), F.col("high").alias("n_high"), F.col("low").alias("n_low"))
    asked = prints.where(F.col("doc_id") % 100 == 0).select(F.struct("doc_id", "key").alias("id"), "high", "low")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    found = within(prints.select("high", "low", each.alias("copy")), asked, near=NEAR).select("id.*", "n_within", "n_near")
    own, other = (F.col("high"), F.col("low")), (F.col("e_high"), F.col("e_low"))
    has_next = F.col("edited_sha256").isNotNull()
    return (
        prints.join(following, ["next_id", "next_key"], "left")
        .join(found, ["doc_id", "key"], "left")
        .withColumn("copy", each)
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            spelled(*own).alias("fingerprint"),
            F.when(has_next, spelled(*other)).alias("edited_fingerprint"),
            F.when(has_next, likeness(*own, *other)).alias("near_edited"),
            likeness(*own, F.col("n_high"), F.col("n_low")).alias("near_next"),
            "n_within",
            "n_near",
        )
    )
