"""Benchmark decontamination by spaced seeds.

Words are lower-cased, without marks and punctuation. A seed is a fixed mask over
neighbouring words; words at ignored positions may differ, so some seed survives where a
passage was edited. Seeds of all test items are joined to seeds of the documents by hash:
each task first drops seeds that cannot be among the items', by a bitmap of fixed size, and
the few that remain meet the items in a join, so neither table need be small.

Around each hit the document's words are laid over the item's words on the hit's diagonal.
The best stretch (a point for each equal word, ``PENALTY`` off for each other) is an overlap
if it holds ``MIN_EQUAL`` equal words, or all words of an item that has fewer.

An item with fewer words than the shortest mask (7) has one seed of all its words and is found where they
stand as they are. Characters of scripts without blanks are words each. Items of equal words are searched as one.

NULL and empty texts hold nothing. Rows that repeat are searched each; overlaps are reported once for
each id and item, of equally large ones the first. Long texts are searched whole, in stretches around hits. Empty
tables give an empty result. Other columns are ignored by the query; in ``uncontaminated`` all columns of the input,
whatever their names, stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.llm.common import U64, Words, absent_name, in_bitmap, mix64, row_key, slices, sparse_counts, table, told_apart
from garbline.llm.registry import query
from garbline.session import cut_lineage, discard_since, scratch_mark

# Fixed masks: 1 is compared, 0 is ignored.
MASKS = ("1111111", "1011011011", "110101101011", "11100011101")
SHORTEST = min(map(len, MASKS))
# Scripts that are written without blanks: each of their characters is a word.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
TELLING = 3  # words that an item must have for the pipeline to drop what merely holds it
MIN_EQUAL = 10
PENALTY = 3
REACH = 64  # words on either side of a hit that are kept for the comparison
BITMAP_BITS = 24


def whole_masks(lengths) -> list[str]:
    """For items too short for any of ``MASKS``, masks of all their words."""
    return ["1" * n for n in sorted(set(lengths)) if 0 < n < SHORTEST]


def seeds(hashed: np.ndarray, starts: np.ndarray, lengths: np.ndarray, masks: list[str]):
    """For each mask, the seed at every word, and whether the mask fits into the text there."""
    left = np.repeat(starts + lengths, lengths) - np.arange(len(hashed))
    for mask in masks:
        number = int(mask, 2) * 64 + len(mask)
        places = [i for i, c in enumerate(mask) if c == "1"]
        n = len(hashed) - len(mask) + 1
        if n <= 0:
            continue
        sums = np.full(n, U64(number))
        for k, place in enumerate(places):
            sums += hashed[place : place + n] * (mix64(np.array([k + 1], U64)) | U64(1))
        yield mix64(sums), left[:n] >= len(mask)


def _words(texts: pa.Array):
    words = Words(pc.replace_substring_regex(texts, UNSPACED, r" \1 "), fold="alnum")
    return words.hashes(), words.starts, words.lengths


def item_table(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``item`` (a key of the words), ``item_id`` and ``words`` (hashes, as bytes) of every test item with words."""

    def run(batches):
        for piece in slices(batches, "text"):
            hashed, starts, lengths = _words(piece.column(1))
            words = [hashed[a : a + n].tobytes() for a, n in zip(starts, lengths)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(words, pa.binary())], names=["item_id", "words"])

    found = items.select(F.col(id_column).cast("long").alias("item_id"), F.col(text_column).alias("text")).mapInArrow(run, "item_id long, words binary")
    return found.where("length(words) > 0").select(F.xxhash64("words").alias("item"), "item_id", "words")


def item_seeds(items: DataFrame) -> DataFrame:
    """``seed``, ``item``, ``at`` (the word where the mask begins) for all seeds of the items; short ones have one, of all words."""

    def run(batches):
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashed = np.frombuffer(words, U64)
                masks = whole_masks([len(hashed)]) or list(MASKS)
                for found, fits in seeds(hashed, np.zeros(1, np.int64), np.array([len(hashed)]), masks):
                    at = np.flatnonzero(fits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[at].view(np.int64)), pa.array(np.full(len(at), item)), pa.array(at)], names=["seed", "item", "at"]
                    )

    return items.select("item", "words").mapInArrow(run, "seed long, item long, at long")


def hits(docs: DataFrame, bitmap: np.ndarray, masks: list[str]) -> DataFrame:
    """``row``, ``doc_id``, ``begin``, ``words``, ``seeds``, ``places``: stretches of the texts that hold seeds on taken places of the
    bitmap, with ``REACH`` words around them."""
    shape = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("words", pa.binary()), ("seeds", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))]
    )

    def run(batches):
        for piece in slices(batches, "text"):
            hashed, starts, lengths = _words(piece.column(2))
            found, places = [np.empty(0, U64)], [np.empty(0, np.int64)]
            for sums, fits in seeds(hashed, starts, lengths, masks):
                at = np.flatnonzero(fits & in_bitmap(bitmap, sums))
                found.append(sums[at])
                places.append(at)
            found, places = np.concatenate(found), np.concatenate(places)
            if not len(places):
                continue
            order = np.argsort(places, kind="stable")
            found, places = found[order], places[order]
            text = np.searchsorted(starts + lengths, places, "right")
            # hits of one text whose surroundings touch form one stretch
            cuts = np.flatnonzero((np.diff(places) > 2 * REACH) | (np.diff(text) > 0)) + 1
            rows = []
            for at, seed, of in zip(np.split(places, cuts), np.split(found, cuts), np.split(text, cuts)):
                t = of[0]
                begin, end = max(starts[t], at[0] - REACH), min(starts[t] + lengths[t], at[-1] + REACH)
                rows.append(
                    {
                        "row": piece.column(0)[int(t)].as_py(), "doc_id": piece.column(1)[int(t)].as_py(), "begin": int(begin - starts[t]),
                        "words": hashed[begin:end].tobytes(), "seeds": seed.view(np.int64), "places": at - starts[t],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return docs.mapInArrow(run, "row long, doc_id long, begin long, words binary, seeds array<long>, places array<long>")


def best_stretch(equal: np.ndarray, penalty: int = PENALTY) -> tuple[int, int, int]:
    """(first, last, equal words) of the best stretch, the end excluded; of equally good ones the longest."""
    score = np.where(equal, 1, -penalty)
    upto = np.concatenate([[0], np.cumsum(score)])
    low = np.minimum.accumulate(upto)
    gain = upto - low
    end = int(np.flatnonzero(gain == gain.max())[-1])
    begin = int(np.argmin(upto[: end + 1]))
    return begin, end, int(equal[begin:end].sum())


def compare(aligned: DataFrame, min_equal: int) -> DataFrame:
    """The overlaps among ``aligned`` (a stretch, an item and a diagonal in each row)."""

    def run(batches):
        shape = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("item", pa.int64()), ("words", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("equal", pa.int64())])
        for batch in batches:
            rows = []
            for row, doc, item, begin, shift, text, words in zip(*(c.to_pylist() for c in batch.columns)):
                text, words = np.frombuffer(text, U64), np.frombuffer(words, U64)
                # word i of the item lies over word i + shift of the document
                low = max(0, begin - shift)
                high = min(len(words), begin + len(text) - shift)
                if high <= low:
                    continue
                a, b, equal = best_stretch(words[low:high] == text[low + shift - begin : high + shift - begin])
                if equal >= min(min_equal, len(words)):
                    rows.append((row, doc, item, len(words), low + a + shift, low + b + shift, equal))
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in rows], schema=shape)

    columns = aligned.select("row", "doc_id", "item", "begin", "shift", "text", "words")
    return columns.mapInArrow(run, "row long, doc_id long, item long, words long, first_word long, last_word long, equal long")


def overlaps(docs: DataFrame, items: DataFrame, min_equal: int = MIN_EQUAL) -> DataFrame:
    """``row``, ``doc_id``, ``item_id``, ``words`` (of the item), ``first_word``, ``last_word``, ``equal`` for every diagonal on which an item overlaps a text.

    ``docs`` has ``row``, ``doc_id`` and ``text``; ``items`` has ``item_id`` and ``text``.
    """
    named = cut_lineage(item_table(items, "item_id", "text"), "named")
    # items of equal words are one until overlaps are known
    listed = cut_lineage(named.groupBy("item").agg(F.first("words").alias("words")), "items")
    asked = cut_lineage(item_seeds(listed), "seeds")
    short = [r["n"] for r in listed.select((F.length("words") / 8).cast("int").alias("n")).where(f"n < {SHORTEST}").distinct().collect()]
    masks = list(MASKS) + whole_masks(short)
    found = cut_lineage(hits(docs.select("row", "doc_id", "text"), sparse_counts(asked, F.col("seed"), BITMAP_BITS), masks), "hits")
    found = found.withColumn("stretch", F.struct("row", "begin"))
    single = found.select("stretch", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("stretch", F.col("h.seeds").alias("seed"), F.col("h.places").alias("place"))
    diagonals = single.join(asked, "seed").select("stretch", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    aligned = diagonals.join(found.select("stretch", "row", "doc_id", "begin", F.col("words").alias("text")), "stretch").join(listed, "item")
    overlap = compare(aligned, min_equal)
    return overlap.join(named.select("item", "item_id"), "item").drop("item")


def contaminated(docs: DataFrame, items: DataFrame, min_equal: int = MIN_EQUAL) -> DataFrame:
    """``doc_id``, ``item_id`` and the place and size of the largest overlap of the two; only where there is one."""
    found = overlaps(docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), items, min_equal)
    best = F.max(F.struct("equal", F.negative("first_word").alias("f"), "last_word"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", F.negative("b.f").alias("first_word"), "b.last_word", F.col("b.equal").alias("equal_words")
    )


@query("op6_decontamination")
def op6_decontamination(spark, sf_dir) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def uncontaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that overlap a test item go. Items of one or two words, which many clean texts hold, drop nothing."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    mark = scratch_mark()
    found = overlaps(docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), items)
    key = absent_name(docs, "row_key")
    bad = cut_lineage(found.where(F.col("words") >= TELLING).select(F.col("row").alias(key)).distinct(), "overlapping")
    discard_since(spark, mark)
    clean, doubtful = told_apart(docs.withColumn(key, row_key("doc_id", "text")), key, bad)
    return clean.unionByName(doubtful.join(bad, key, "left_anti")).drop(key)
