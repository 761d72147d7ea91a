"""What the operators share: reading tables, the training split, word arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garbline.session import configure, cut_lineage

# Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
FOLDS = 5
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the documents that no model may learn labels from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def row_key(*columns: str) -> Column:
    """A name of a row by some of its columns; rows equal in them share it."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def absent_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each (non-null) string, from its UTF-8 bytes, the same in every process.

    Works on all values at once: byte ``i`` of a value is weighted by an odd power, and
    the weighted sum and the length are scrambled. Long values cost no extra pass.
    """
    values = values.cast(pa.large_string())
    if len(values) == 0:
        return np.empty(0, U64)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, lengths)
    sums = segment_sums(mix64((raw.astype(U64) + U64(1)) + (place.astype(U64) << U64(8))), starts, lengths)
    return mix64(sums ^ (lengths.astype(U64) * U64(0x9E3779B97F4A7C15)))


def segment_sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments, empty ones included; wraps for unsigned integers."""
    if len(values) == 0:
        return np.zeros((len(starts), *values.shape[1:]), values.dtype)
    padded = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])
    sums = np.add.reduceat(padded, starts, axis=0)
    sums[lengths == 0] = 0
    return sums


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of text, one row at least.

    Pieces are copies of their own: Arrow's text functions misread arrays that begin inside a buffer.
    """
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.take(pa.array(np.arange(start, min(end, batch.num_rows))))
            start = end


class Words:
    """The words of a column of texts: distinct ones, a code for each word, the bounds of each text."""

    def __init__(self, texts: pa.Array, fold: str = "ascii") -> None:
        texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
        if fold != "none":
            texts = pc.ascii_lower(texts) if fold == "ascii" else pc.utf8_lower(texts)
        if fold == "alnum":
            texts = pc.replace_substring_regex(texts, r"[^\p{L}\p{N}\s]+", "")
        parts = pc.ascii_split_whitespace(texts)
        flat = parts.flatten()
        lists = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        # leading and trailing white space leaves empty words
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if not full.all():
            owner = np.repeat(np.arange(len(lists)), lists)
            lists = np.bincount(owner[full], minlength=len(lists)).astype(np.int64)
            flat = flat.filter(pa.array(full))
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.distinct = coded.dictionary
        self.lengths = lists
        self.starts = np.cumsum(lists) - lists

    def hashes(self) -> np.ndarray:
        """The 64-bit hash of every word, in order."""
        return hash_strings(self.distinct)[self.codes] if len(self.codes) else np.empty(0, U64)


def labelled_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id`` and ``label`` (0 or 1) of about ``most`` training rows of each label, fewer where there are fewer.

    Chosen by a hash of the id, so reruns agree. Ids with both labels count as 1; held-out ids
    and rows without an id or label are left out. ``most`` bounds what is broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id"))
    once = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    found = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1_000_000))
    share = F.lit(0)
    for value, n in found.items():
        share = F.when(F.col("label") == value, F.lit(int(1_000_000 * min(1.0, most / n)))).otherwise(share)
    return once.where(place < share)


def sparse_counts(df: DataFrame, hashed: Column, bits: int) -> np.ndarray:
    """A bitmap of ``2**bits`` places with those set that ``hashed`` (a bigint column) falls on.

    Its size is fixed by ``bits``, not by the data, which bounds what reaches the driver
    and what is sent to the tasks; more values than places only make it less selective.
    """
    place = F.shiftrightunsigned(hashed, 64 - bits)
    words = (
        df.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int")).alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    bitmap = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    rows = words.toPandas()
    bitmap[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return bitmap.view(U64)


def told_apart(rows: DataFrame, key: str, wanted: DataFrame, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` (a bigint) is surely not among the column ``key`` of ``wanted``, and those where it may be.

    Only the second part need be shuffled to find out. A bitmap of ``2**bits`` places, whatever the
    number of keys, tells them apart where the rows are read; a full one costs time, never a result.
    """
    place = F.shiftrightunsigned(F.col(key), 64 - bits)
    word, bit = F.shiftright(place, 6), place.bitwiseAND(63).cast("int")
    marks = wanted.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("b"))
    every = rows.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    words = marks.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    dense = cut_lineage(words.agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("all")).select(F.col("all.b").alias("words")), "bitmap")
    hit = F.call_function("shiftrightunsigned", F.get(dense.scalar(), word.cast("int")), bit).bitwiseAND(1) == 1
    maybe = F.coalesce(hit, F.lit(False))
    return rows.where(~maybe), rows.where(maybe)


def in_bitmap(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) fall on a set place of the bitmap."""
    bits = int(len(bitmap)).bit_length() - 1 + 6
    place = hashed >> U64(64 - bits)
    return (bitmap[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) == 1


def score_texts(df: DataFrame, text: str, added: str, score, limit: int = 1 << 20) -> DataFrame:
    """``df`` with the columns of the DDL ``added``, which replace columns of the same names.

    ``score`` gets the column ``text`` of a slice of rows as an Arrow array and returns one
    array for each added column. Runs on the partitions as they are, a slice at a time.
    """
    extra = T.StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name not in extra.names]
    # the text may itself be replaced, so it travels under a name of its own
    source = df.select(*[df[f.name] for f in kept], df[text].cast("string").alias("_scored_text"))

    def run(batches):
        for piece in slices(batches, "_scored_text", limit):
            texts = piece.column(piece.schema.names.index("_scored_text"))
            columns = [piece.column(i) for i in range(len(kept))] + list(score(texts))
            yield pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], names=names)

    names = [f.name for f in kept] + extra.names
    return source.mapInArrow(run, T.StructType(kept + extra.fields))
