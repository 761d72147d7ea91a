"""Similarity self-join of the documents on word n-grams: a size-aware heavy-light join.

Documents with equal sets of n-grams are one class. Two classes link when
``100 * |intersection| >= percent * |union|``. All n-grams stand in one global order: first
those that few documents hold, then the frequent ones, each by hash. A set of ``n`` grams
shares at least ``need(n)`` with any partner, so two linked sets meet

* in one of their first ``n - need(n) + 1`` grams, and
* in a pair of grams among their first ``n - need(n) + 2``.

Small sets enumerate these pairs (subsets of fixed size two), which hardly any other set
holds; large sets, for which the pairs would be too many, are found by scanning the
inverted lists of the single grams. The boundary is the size at which enumerating costs
more than scanning, from the numbers of documents by size and the mean length of the lists.
Sets a little below it do both, as their partners may be above.

A list of up to ``LIGHT`` sets gives all its pairs; a pair must share enough of its first
grams to reach its overlap with all that may follow. A longer list (copies with small edits, or
texts made of common passages) is compared with the member that shares most grams with
others, the least edited copy. Sets that link become one component, and only where a list
holds several is it compared with another member for some rounds and at last pair by pair
across components. A member leaves a list in which nobody can have enough first grams in
common with it, and a pair across components is left out where the triangle inequality of
the Jaccard distance or the sketches of the two sets exclude a link: a sketch has a bit for each
of ``SKETCH`` places, set if an odd number of grams fall on it, so two sketches never differ
in more bits than the sets do in grams. No link between different components is lost,
whatever the length of a list.

N-grams are 64-bit hashes of the words, classes 64-bit hashes of the sets. Every candidate is
verified on the whole sets. The order needs only to be the same everywhere, so the frequent
grams are kept as a bitmap of fixed size: a gram that falls on a taken place is merely late.

NULL and blank texts have no grams and link with nothing, not even each other. Texts with
fewer words than ``n`` have one gram, all their words. Repeated rows, also of one id, are
one class; a NULL id never names a component that has another. Texts are read whole, long ones alone. An empty
table gives an empty result. In ``representatives`` all columns of the input, whatever their names, stay as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garbline.functions.graph import components
from garbline.llm.common import U64, Words, absent_name, in_bitmap, mix64, row_key, slices, sparse_counts, table, told_apart
from garbline.llm.registry import query
from garbline.session import cut_and_count, cut_lineage, discard_since, scratch_mark

N = 5
PERCENT = 80
LIGHT = 32  # longest list of which all pairs are taken; grams in more documents are late in the order
ROUNDS = 1
SKETCH = 2048
BITMAP_BITS = 24
PER_RANGE = 1 << 19  # grams counted together
COUNTED = U64(1) << U64(63)  # hashes below are counted
FLUSH = 1 << 21  # grams a task holds before it passes them on
_FACTORS = mix64(np.arange(1, 65, dtype=U64)) | U64(1)


def need(n, percent: int = PERCENT):
    """Grams that a set of ``n`` shares with any partner."""
    return -(-percent * n // 100)


def gram_hashes(words: Words, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all n-grams of the texts, in order, with the starts and counts by text."""
    hashed = words.hashes()
    counts = np.where(words.lengths >= n, words.lengths - n + 1, (words.lengths > 0).astype(np.int64))
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    first = words.starts[owner] + np.arange(len(owner)) - starts[owner]
    size = np.minimum(words.lengths, n)[owner]
    sums = size.astype(U64) * _FACTORS[-1]
    for k in range(n):
        there = size > k
        sums[there] += hashed[first[there] + k] * _FACTORS[k]
    return mix64(sums), starts, counts


def gram_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """The set of each text as an ascending array."""
    grams, starts, counts = gram_hashes(Words(texts), n)
    return [np.unique(grams[a : a + c]) for a, c in zip(starts, counts)]


def class_key(grams: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(mix64(np.sum(mix64(grams ^ U64(0x5851F42D4C957F2D)), keepdims=True) + U64(len(grams))).view(np.int64)[0])


def classes(docs: DataFrame, id_column: str, text_column: str, n: int) -> DataFrame:
    """``row`` (a key of id and text), ``doc_id``, ``n_shingles`` and ``cls`` (NULL for an empty set) of every row."""

    def run(batches):
        for piece in slices(batches, "text"):
            sets = gram_sets(piece.column(2), n)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    piece.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_key(s) if len(s) else None for s in sets], pa.int64()),
                ],
                names=["row", "doc_id", "n_shingles", "cls"],
            )

    named = docs.select(row_key(id_column, text_column).alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return named.mapInArrow(run, "row long, doc_id long, n_shingles long, cls long")


def _new_sets(batches, n: int):
    """The sets of a task's texts, each class once, with their names."""
    seen = set()
    for piece in slices(batches, "text"):
        for grams in gram_sets(piece.column(0), n):
            if len(grams):
                name = class_key(grams)
                if name not in seen:
                    seen.add(name)
                    yield name, grams


def frequent_grams(texts: DataFrame, n: int, total: int, light: int = LIGHT) -> tuple[np.ndarray, float]:
    """A bitmap of the grams that more than ``light`` documents hold, and the mean number of other
    documents that hold a gram which is not among them.

    Only grams below ``COUNTED`` are counted, half of all; the others follow them in the order, and count
    as frequent wherever a set is so full of frequent grams that it needs them (see ``signatures``). Tasks
    count first, then ranges of hashes are summed, about ``PER_RANGE`` grams at a time.
    """
    bits = max(4, math.ceil(math.log2(max(2, total) / PER_RANGE + 1)))

    def count(batches):
        held, size = [], 0

        def passed_on():
            values, often = np.unique(np.concatenate(held), return_counts=True)
            ranges = (values >> U64(64 - bits)).astype(np.int64)
            values = ((values << U64(bits)) >> U64(32)).astype(np.uint32)
            often = np.minimum(often, np.iinfo(np.uint16).max).astype(np.uint16)
            cuts = np.flatnonzero(np.diff(ranges)) + 1
            rows = [
                (int(r[0]), v.tobytes(), o.tobytes())
                for r, v, o in zip(np.split(ranges, cuts), np.split(values, cuts), np.split(often, cuts))
            ]
            return pa.RecordBatch.from_pylist([dict(zip(("range", "grams", "often"), r)) for r in rows], schema=shape)

        shape = pa.schema([("range", pa.int64()), ("grams", pa.binary()), ("often", pa.binary())])
        for _, grams in _new_sets(batches, n):
            held.append(grams[grams < COUNTED])
            size += len(held[-1])
            if size >= FLUSH:
                yield passed_on()
                held, size = [], 0
        if held:
            yield passed_on()

    def add_up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["grams"]])
        often = np.concatenate([np.frombuffer(x, np.uint16) for x in frame["often"]]).astype(np.int64)
        values, where = np.unique(values, return_inverse=True)
        often = np.bincount(where, weights=often).astype(np.int64)
        hot = often > light
        rare = often[~hot]
        top = (U64(key[0]) << U64(64 - bits)) | (values[hot].astype(U64) << U64(32 - bits))
        out = pd.DataFrame({"gram": top.view(np.int64), "held": 0, "met": 0})
        out.loc[len(out)] = [None, int(rare.sum()), int((rare * (rare - 1)).sum())]
        return out.astype({"gram": "Int64", "held": "int64", "met": "int64"})

    parts = texts.mapInArrow(count, "range long, grams binary, often binary")
    sums = cut_lineage(parts.groupBy("range").applyInPandas(add_up, "gram long, held long, met long"), "frequent")
    met = sums.agg(F.sum("held").alias("held"), F.sum("met").alias("met")).first()
    # the lowest bits of the names are unknown here, so places are taken from the highest
    bitmap = sparse_counts(sums.where("gram is not null"), F.col("gram"), min(BITMAP_BITS, 32))
    return bitmap, (met["met"] or 0) / max(1, met["held"] or 0)


def boundary(by_size: dict[int, int], mean_list: float, percent: int = PERCENT) -> int:
    """The size from which sets are found by scanning lists; smaller ones enumerate pairs."""
    top = max([n for n in by_size], default=0) + 1

    def enumerating(n: int) -> float:
        return math.comb(n - need(n, percent) + 2, 2)

    def scanning(n: int) -> float:
        return (n - need(n, percent) + 1) * (1 + mean_list)

    def cost(x: int) -> float:
        small = sum(c * enumerating(n) for n, c in by_size.items() if n < x)
        return small + sum(c * scanning(n) for n, c in by_size.items() if n >= need(x, percent))

    return min(range(1, top + 1), key=lambda x: (cost(x), x))


def signatures(texts: DataFrame, n: int, percent: int, bitmap: np.ndarray, limit: int) -> DataFrame:
    """``sig``, ``cls``, ``n``, ``late``: the grams, or pairs of grams, in which a set may meet a partner.

    Grams are odd, pairs even. ``late`` tells that nothing is known against a long list: the gram
    (of a pair, each gram) is frequent or was not counted. It depends on the grams alone, so a list is late as a whole.
    """
    one = U64(1)
    def run(batches):
        sigs, flags, names, sizes, held = [], [], [], [], 0

        def out():
            reach = [len(s) for s in sigs]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(names, reach)),
                    pa.array(np.repeat(sizes, reach).astype(np.int32)), pa.array(np.concatenate(flags)),
                ],
                names=["sig", "cls", "n", "late"],
            )

        for name, grams in _new_sets(batches, n):
            size = len(grams)
            often = in_bitmap(bitmap, grams)
            # order of the grams, of which only the first are needed
            grams = np.concatenate([grams[~often], grams[often]])
            late = np.concatenate([grams[: size - often.sum()] >= COUNTED, np.ones(often.sum(), bool)])
            spare = size - need(size, percent)
            mine, slow = [], []
            if size >= need(limit, percent):
                mine.append(mix64(grams[: spare + 1]) | one)
                slow.append(late[: spare + 1])
            # a set that shares less than two grams with a partner equals it
            if size < limit and need(size, percent) >= 2:
                i, j = np.triu_indices(min(spare + 2, size), 1)
                mine.append(mix64(mix64(grams[i]) * U64(3) + grams[j]) & ~one)
                slow.append(late[i] & late[j])
            if mine:
                sigs.append(np.concatenate(mine))
                flags.append(np.concatenate(slow))
                names.append(name)
                sizes.append(size)
                held += len(sigs[-1])
            if held > 1 << 18:
                yield out()
                sigs, flags, names, sizes, held = [], [], [], [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, "sig long, cls long, n int, late boolean")


def met_lists(entries: DataFrame, light: int = LIGHT) -> DataFrame:
    """The entries that may be in lists with two sets or more: ``sig``, ``cls``, ``n`` and ``later``, the sets that follow in the list.

    ``later`` is NULL in long lists, and in those of late signatures, which may be of any length.
    One shuffle, by signature; entries of late signatures are dealt out by set as well, so that
    no list meets in one task. Copies of a class from several tasks are one entry.
    """
    places = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.when(F.col("late"), F.pmod(F.xxhash64("cls"), F.lit(places))).otherwise(F.lit(-1)).cast("int")
    once = entries.select("sig", "cls", "n", dealt.alias("place")).repartition("sig", "place").groupBy("sig", "place", "cls").agg(F.min("n").alias("n"))
    here = Window.partitionBy("sig", "place")
    shared = once.withColumn("members", F.count("*").over(here)).where("members > 1 or place >= 0")
    following = F.collect_list(F.struct("cls", "n")).over(here.orderBy("cls").rowsBetween(1, light - 1))
    whole = (F.col("place") < 0) & (F.col("members") <= light)
    return shared.select("sig", "cls", "n", F.when(whole, following).alias("later"))


def _pairs(left: DataFrame, percent: int) -> DataFrame:
    """Ordered pairs ``a`` < ``b`` of different sets, with their sizes, whose sizes allow a link; once each, with the sum of ``k``."""
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    swap = F.col("a") > F.col("b")
    ordered = left.where(fits & (F.col("a") != F.col("b"))).select(
        F.least("a", "b").alias("a"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"),
        F.greatest("a", "b").alias("b"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"), "k",
    )
    return ordered.groupBy("a", "na", "b", "nb").agg(F.sum("k").alias("k"))


def _least_shared(na: str, nb: str, percent: int) -> str:
    """SQL for the number of first grams that linked sets of these sizes share at least.

    Take the set whose first grams end earlier in the order: with its first
    ``n - need(n) + 1`` grams it shares what both have among their first ones, and with the rest at
    most ``need(n) - 1``.
    """
    overlap = f"(({percent} * ({na} + {nb}) + {99 + percent}) div {100 + percent})"
    return f"({overlap} - (({percent} * greatest({na}, {nb}) + 99) div 100) + 1)"


def _least_with_any(low: str, high: str, percent: int) -> str:
    """SQL for a bound that ``_least_shared`` of a set of ``n`` keeps to with every partner of ``low`` to ``high`` grams, ``n`` among them.

    Towards smaller partners it falls steadily. Towards larger ones it falls only but for the
    roundings, which add less than one, so the difference is rounded as a whole.
    """
    large = f"(({percent} * (100 * n - {percent} * least({high}, (100 * n) div {percent}))) div {100 * (100 + percent)} + 1)"
    return f"least({_least_shared('n', f'greatest({low}, ({percent} * n + 99) div 100)', percent)}, {large})"


def enough_shared(pairs: DataFrame, heavy: DataFrame, percent: int, limit: int) -> DataFrame:
    """The pairs that share enough of their first grams to link.

    ``k`` counts the short lists of single grams in which a pair meets; ``heavy`` (``cls``, ``lists``) the
    long ones that a set is in, in each of which it may meet a partner too.
    """
    long_lists = pairs
    for end in ("a", "b"):
        long_lists = long_lists.join(heavy.select(F.col("cls").alias(end), F.col("lists").alias(f"_{end}")), end, "left")
    shared = "k + least(coalesce(_a, 0), coalesce(_b, 0))"
    enough = f"least(na, nb) < {need(limit, percent)} or {shared} >= {_least_shared('na', 'nb', percent)}"
    return long_lists.where(enough).select(*pairs.columns)


def able_to_link(met: DataFrame, percent: int, limit: int) -> DataFrame:
    """The entries of long lists whose set may link with one of another size in the list, with ``t`` and ``center``.

    ``t`` is the number of lists of single grams that a set shares with anyone. Copies with so many
    edits that they share too few grams leave here, before anything is compared. The
    list's ``center`` is the set with the largest ``t``.
    """
    open_lists = met.where("later is null").select("sig", "cls", "n")
    span = open_lists.groupBy(F.col("sig").alias("_sig")).agg(F.count("*").alias("_m"), F.min("n").alias("_low"), F.max("n").alias("_high"))
    long = open_lists.join(cut_lineage(span.where("_m > 1"), "span"), F.col("sig") == F.col("_sig")).drop("_sig", "_m")
    long = cut_lineage(long, "long")
    single = met.where("later is not null").select("sig", "cls").unionByName(long.select("sig", "cls")).where("sig % 2 <> 0")
    own = single.groupBy(F.col("cls").alias("_cls")).agg(F.count("*").alias("t"))
    counted = long.join(cut_lineage(own, "shared"), F.col("cls") == F.col("_cls"), "left").withColumn("t", F.coalesce("t", F.lit(0)))
    # the farther apart the sizes, the fewer grams need be shared
    able = f"sig % 2 = 0 or n < {need(limit, percent)} or t >= {_least_with_any('_low', '_high', percent)}"
    rows = cut_lineage(counted.where(able).select("sig", "cls", "n", "t"), "able")
    center = F.max_by(F.struct("cls", "n"), F.struct("t", "cls")).alias("center")
    centers = rows.groupBy(F.col("sig").alias("_sig")).agg(center)
    return rows.join(cut_lineage(centers, "centers"), F.col("sig") == F.col("_sig")).drop("_sig")


def candidate_sets(texts: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """``cls`` and ``grams`` (the set, as bytes) of the classes of ``wanted``, each once.

    A bitmap of fixed size keeps most other sets from being shuffled; the join removes the rest.
    """
    bitmap = sparse_counts(wanted, F.col("cls"), BITMAP_BITS)

    def run(batches):
        names, sets, held = [], [], 0
        for name, grams in _new_sets(batches, n):
            if in_bitmap(bitmap, np.array([name], np.int64).view(U64))[0]:
                names.append(name)
                sets.append(grams.tobytes())
                held += len(sets[-1])
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "grams"])
                names, sets, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "grams"])

    sets = texts.mapInArrow(run, "cls long, grams binary")
    return sets.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("grams").alias("grams"))


def sketches(sets: DataFrame, bits: int = SKETCH) -> DataFrame:
    """``cls`` and the words ``s0``, ``s1``, ... of the sketch of each set."""
    names = [f"s{i}" for i in range(bits // 64)]
    shift = U64(64 - (bits - 1).bit_length())

    def run(batches):
        for batch in batches:
            odd = np.zeros((batch.num_rows, bits), np.uint8)
            for row, grams in zip(odd, batch.column(1).to_pylist()):
                row[:] = np.bincount((np.frombuffer(grams, U64) >> shift).astype(np.int64), minlength=bits) & 1
            words = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in words.T]], names=["cls", *names])

    return sets.select("cls", "grams").mapInArrow(run, ", ".join(["cls long", *[f"{n} long" for n in names]]))


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``, ``linked`` and ``apart`` (the Jaccard distance) of every pair, from the whole sets."""

    def run(batches):
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                rows.append((a, b, 100 * both >= percent * union, 1 - both / union))
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["a", "b", "linked", "apart"])

    one = sets.select(F.col("cls").alias("a"), F.col("grams").alias("x"))
    other = sets.select(F.col("cls").alias("b"), F.col("grams").alias("y"))
    joined = pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long, linked boolean, apart double")


def links(docs: DataFrame, found: DataFrame, id_column: str, text_column: str, n: int = N, percent: int = PERCENT, light: int = LIGHT, rounds: int = ROUNDS) -> DataFrame:
    """Pairs ``a``, ``b`` of classes whose transitive closure has every link between different texts."""
    texts = docs.select(F.col(text_column).alias("text"))
    sizes = found.where("n_shingles > 0").select("cls", "n_shingles").distinct()
    small = {r["n_shingles"]: r["count"] for r in sizes.where("n_shingles <= 256").groupBy("n_shingles").count().collect()}
    total = found.agg(F.sum("n_shingles").alias("s")).first()["s"] or 0
    bitmap, mean_list = frequent_grams(texts, n, total, light)
    bound = boundary(small, mean_list, percent)
    met = cut_lineage(met_lists(signatures(texts, n, percent, bitmap, bound), light), "lists")
    member = [F.col("cls").alias("a"), F.col("n").alias("na")]
    single = F.pmod("sig", F.lit(2)).alias("k")
    short = met.where("later is not null").select(*member, single, F.explode("later").alias("o")).select("a", "na", F.col("o.cls").alias("b"), F.col("o.n").alias("nb"), "k")
    long = cut_lineage(able_to_link(met, percent, bound), "long")
    heavy = cut_lineage(long.groupBy("cls").agg(F.sum(F.pmod("sig", F.lit(2))).alias("lists")), "heavy")
    first = long.select(*member, F.col("center.cls").alias("b"), F.col("center.n").alias("nb"), F.lit(0).cast("long").alias("k"))
    pairs = cut_lineage(enough_shared(_pairs(short.unionByName(first), percent), heavy, percent, bound), "pairs")
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(heavy.select("cls"))
    sets = cut_lineage(candidate_sets(texts, n, cut_lineage(ends.distinct(), "wanted")), "sets")
    tested = cut_lineage(compare(pairs, sets, percent), "tested")
    edges = tested.where("linked").select("a", "b")
    if heavy.isEmpty():
        return edges
    # distance of each member of a long list from its center, to spare comparisons later
    away = tested.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "apart")
    ends = (F.least("cls", "center.cls") == F.col("_a")) & (F.greatest("cls", "center.cls") == F.col("_b"))
    distance = F.when(F.expr("cls = center.cls"), 0.0).otherwise(F.col("apart")).alias("apart")
    drawn = cut_lineage(sketches(sets.join(heavy.select("cls"), "cls", "left_semi")), "sketches")
    marks = drawn.columns[1:]
    lists = cut_lineage(long.join(away, ends, "left").select("sig", "cls", "n", "t", distance).join(drawn, "cls"), "long")
    apart_at_least = " + ".join(f"bit_count({m} ^ _{m})" for m in marks)
    for turn in range(rounds + 1):
        roots = cut_lineage(components(edges), "roots")
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        named = lists.join(roots, lists["cls"] == roots["node"], "left").select(*lists.columns, F.coalesce("root", "cls").alias("root"))
        mixed = named.groupBy("sig").agg(F.min("root").alias("_r"), F.max("root").alias("_s")).where("_r <> _s").select("sig")
        named, left = cut_and_count(named.join(mixed, "sig", "left_semi"), "named")
        if not left:
            break
        lists = named.drop("root")
        if turn < rounds:
            pick = F.min_by(F.struct(*named.columns), F.xxhash64("cls", F.lit(turn)))
            others = named.groupBy("sig").agg(pick.alias("o")).select("o.*")
        else:
            others = named
        new_names = {"cls": "b", "n": "nb", "t": "tb", "apart": "far", "root": "other"} | {m: f"_{m}" for m in marks}
        others = others.withColumnsRenamed(new_names)
        possible = F.col("apart").isNull() | F.col("far").isNull() | (F.abs(F.col("apart") - F.col("far")) * 100 <= 100 - percent + 1e-6)
        fits = F.expr(f"least(n, nb) < {need(bound, percent)} or least(t, tb) >= {_least_shared('n', 'nb', percent)}")
        # with an overlap of need, the sets differ in the other grams of both
        unlike = F.expr(f"{apart_at_least} <= n + nb - 2 * (({percent} * (n + nb) + {99 + percent}) div {100 + percent})")
        met_again = named.join(others, "sig").where((F.col("root") != F.col("other")) & (F.col("cls") != F.col("b")) & possible & fits & unlike)
        fresh = _pairs(met_again.select(F.col("cls").alias("a"), F.col("n").alias("na"), "b", "nb", F.lit(0).cast("long").alias("k")), percent)
        fresh = cut_lineage(fresh.join(tested, ["a", "b"], "left_anti"), "pairs")
        more = cut_lineage(compare(fresh, sets, percent), "tested")
        tested, edges = tested.unionByName(more), edges.unionByName(more.where("linked").select("a", "b"))
    return edges


def grouped(docs: DataFrame, id_column: str, text_column: str, n: int, percent: int, light: int, rounds: int) -> DataFrame:
    """``row``, ``doc_id``, ``n_shingles``, ``root`` (of the component; NULL without words) and ``component_id`` of every row."""
    found = cut_lineage(classes(docs, id_column, text_column, n), "classes")
    mark = scratch_mark()
    named = cut_lineage(found.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id")), "names")
    roots = components(links(docs, found, id_column, text_column, n, percent, light, rounds))
    joined = cut_lineage(
        named.join(roots, named["cls"] == roots["node"], "left").select("cls", "first_id", F.coalesce("root", "cls").alias("root")), "joined"
    )
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = cut_lineage(joined.join(least, "root").select("cls", "root", "component_id"), "components")
    discard_since(docs.sparkSession, mark)
    # rows without a class meet nothing and stay where they are
    nothing = F.lit(None).cast("long")
    blank = found.where("cls is null").select("row", "doc_id", "n_shingles", nothing.alias("root"), F.col("doc_id").alias("component_id"))
    full = found.where("cls is not null").join(of_class, "cls")
    return full.select("row", "doc_id", "n_shingles", "root", "component_id").unionByName(blank)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = N, percent: int = PERCENT, light: int = LIGHT, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id reachable by links) of every row."""
    return grouped(docs, id_column, text_column, n, percent, light, rounds).select("doc_id", "n_shingles", "component_id")


@query("op3_ngram_join")
def op3_ngram_join(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def representatives(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest id stays, whole; rows without words stay.

    Only rows that may have to go are looked up by key, so that the kept texts need not be
    shuffled. Of rows equal in id and text one stays.
    """
    groups = cut_lineage(grouped(docs, "doc_id", "text", N, PERCENT, LIGHT, ROUNDS).where("root is not null"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("f")
    kept = groups.groupBy("root").agg(first).select(F.col("f.row").alias("row"))
    counts = groups.groupBy("row").agg(F.count("*").alias("n"))
    key = absent_name(docs, "row_key")
    lost = counts.join(kept.withColumn("kept", F.lit(True)), "row", "left").where("n > 1 or kept is null")
    gone = cut_lineage(lost.select(F.col("row").alias(key), F.col("kept").isNotNull().alias("once")), "gone")
    stay, doubtful = told_apart(docs.withColumn(key, row_key("doc_id", "text")), key, gone)
    cleared = doubtful.join(gone.select(key), key, "left_anti")
    again = doubtful.join(gone.where("once").select(key), key, "left_semi").dropDuplicates([key])
    return stay.unionByName(cleared).unionByName(again).drop(key)
