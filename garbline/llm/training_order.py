"""Training-order materialisation: documents as fixed-length token sequences in shuffled global slots.

Every text is encoded, closed with an end token and cut into sequences of ``length`` tokens.
The sequences are numbered without gaps, and a keyed Feistel network over the next power of
four permutes the numbers; a result outside the range is sent through the network again
until it falls inside (cycle-walking), so every sequence gets one slot of ``0 .. n - 1`` and
every slot one sequence. Slots are written in shards of ``stride`` slots, each shard one Parquet
file sorted by slot, with records of equal size: slot ``s`` is row ``s % stride`` of shard
``s / stride``, so a reader can stop after any slot and go on from there. The files are compressed,
so a row is found by its number, through the file's row groups, and not by a byte offset.

Encoded sequences are first written compressed with their place in their task; a task's
numbers follow those of the tasks before it, so only one count for each task reaches the
driver. Numbers follow the order of the input's files and their rows: a run over the same files gives the
same slots, one over other files of the same rows does not.

NULL and empty texts give no sequence. Rows that repeat give sequences each; nothing is ordered by id, so there
are no ties. A NULL id stays NULL. Long texts are encoded whole, long runs of white space too. An empty table gives
one empty shard table. Other columns are ignored. The vocabulary's path is a parameter; the driver reads it.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.llm.common import U64, mix64, slices, table
from garbline.llm.registry import query
from garbline.session import cut_lineage, discard_since, scratch_mark, scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
LENGTH = 1024
STRIDE = 8192
KEY = 2024
NETWORK_ROUNDS = 6
SHARDS = 2  # that one task writes
AT_ONCE = 256  # records unpacked together
LEVEL = 6  # of the compression of sequences that wait for their slot
# Fixed: how the vocabulary splits texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# What the pattern above calls white space, in runs too long for it.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % 10_000)


def encoding(vocabulary: bytes):
    """The tokenizer of a rank file's content."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, tokenizer) -> np.ndarray:
    """The tokens of a text as the library gives them.

    The library's splitting pattern gives up on long runs of white space, so these are cut out first. A run is
    one piece if it ends the text; else all of it but its last character is, which belongs to what follows.
    """
    found, done = [], 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        found += [tokenizer.encode_to_numpy(text[done : run.start()], disallowed_special=())] if run.start() > done else []
        found.append(np.asarray(tokenizer._encode_single_piece(text[run.start() : end]), np.uint32))
        done = end
    if done < len(text) or not found:
        found.append(tokenizer.encode_to_numpy(text[done:], disallowed_special=()))
    return np.asarray(found[0] if len(found) == 1 else np.concatenate(found))


def feistel(numbers: np.ndarray, half: int, key: int) -> np.ndarray:
    """A keyed permutation of ``0 .. 4**half - 1``."""
    mask = U64((1 << half) - 1)
    left, right = numbers >> U64(half), numbers & mask
    for turn in range(NETWORK_ROUNDS):
        secret = mix64(np.array([(key << 8) + turn], U64))
        left, right = right, left ^ (mix64(right ^ secret) & mask)
    return (left << U64(half)) | right


def slots_of(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slot of each number of ``0 .. n - 1``."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    out = feistel(numbers.astype(U64), half, key)
    outside = np.flatnonzero(out >= U64(n))
    while len(outside):
        out[outside] = feistel(out[outside], half, key)
        outside = outside[out[outside] >= U64(n)]
    return out.astype(np.int64)


def encoded(docs: DataFrame, path: str, length: int, end: int) -> DataFrame:
    """``task``, ``at`` (place in the task), ``doc_id``, ``part``, ``n_tokens``, ``packed`` (compressed little-endian tokens)."""
    kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")
    with open(path, "rb") as file:
        vocabulary = file.read()  # about half a megabyte, sent with the job

    def run(batches):
        task, at, tokenizer = TaskContext.get().partitionId(), 0, encoding(vocabulary)
        codec = pa.Codec("zstd", LEVEL)
        for piece in slices(batches, "text"):
            rows = []
            for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                if not text:
                    continue
                tokens = np.append(encode(text, tokenizer), end).astype(kind)
                for part, first in enumerate(range(0, len(tokens), length)):
                    some = tokens[first : first + length]
                    rows.append((task, at, doc, part, len(some), codec.compress(some.tobytes(), asbytes=True)))
                    at += 1
            if rows:
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), shape.types)]
                yield pa.RecordBatch.from_arrays(columns, schema=shape)

    shape = pa.schema([("task", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int32()), ("packed", pa.binary())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "task int, at long, doc_id long, part int, n_tokens int, packed binary"
    )


def in_training_order(docs: DataFrame, target: str, path: str = VOCABULARY, length: int = LENGTH, stride: int = STRIDE, key: int = KEY, end: int = END) -> DataFrame:
    """Write the shards below ``target`` and return them: ``slot``, ``shard``, ``doc_id``, ``part``, ``n_tokens``, ``tokens``.

    ``tokens`` are ``length`` little-endian integers of 2 bytes (4 if ``end`` needs them), filled up
    with ``end``. A shard is a folder with one file. The write is committed as a whole; a rerun
    after a failure starts from the table of encoded sequences only within the same job.
    """
    spark = docs.sparkSession
    mark = scratch_mark()
    held = cut_lineage(encoded(docs, path, length, end), "encoded")
    counts = {r["task"]: r["n"] for r in held.groupBy("task").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for task in sorted(counts):
        before[task] = total
        total += counts[task]
    kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")
    width = length * kind.itemsize
    filler = np.full(length, end, kind).tobytes()

    def place(batches):
        for batch in batches:
            tasks = batch.column(0).to_numpy()
            base = np.array([before[t] for t in tasks.tolist()], np.int64)
            slots = slots_of(base + batch.column(1).to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array(slots // stride), *batch.columns[2:]], names=["slot", "shard", "doc_id", "part", "n_tokens", "packed"]
            )

    def unpack(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                some, full = batch.slice(first, AT_ONCE), []
                for n, packed in zip(some.column(4).to_pylist(), some.column(5).to_pylist()):
                    size = n * kind.itemsize
                    full.append(pa.decompress(packed, size, "zstd", asbytes=True) + filler[size:width])
                yield pa.RecordBatch.from_arrays([*some.columns[:5], pa.array(full, pa.binary())], names=["slot", "shard", "doc_id", "part", "n_tokens", "tokens"])

    columns = "slot long, shard long, doc_id long, part int, n_tokens int"
    # each task writes a few neighbouring shards, however many there are
    tasks = max(1, -(-total // (stride * SHARDS)))
    placed = held.mapInArrow(place, f"{columns}, packed binary").repartitionById(tasks, F.expr(f"cast(shard div {SHARDS} as int)"))
    whole = placed.mapInArrow(unpack, f"{columns}, tokens binary").sortWithinPartitions("shard", "slot")
    whole.write.option("compression", "zstd").partitionBy("shard").parquet(target)
    discard_since(spark, mark, keep=0)
    return spark.read.schema(f"slot long, doc_id long, part int, n_tokens int, tokens binary, shard long").parquet(target)


def read_from(shards: DataFrame, slot: int, n: int, stride: int = STRIDE) -> DataFrame:
    """The records of ``n`` slots from ``slot`` on, in order; only their shards are read."""
    inside = (F.col("shard") >= slot // stride) & (F.col("shard") <= (slot + n - 1) // stride)
    return shards.where(inside & (F.col("slot") >= slot) & (F.col("slot") < slot + n)).orderBy("slot")


def materialised(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: write the shards and return a digest of every record."""
    shards = in_training_order(docs.select("doc_id", "text"), scratch_path(spark, "shards"))
    return shards.select("slot", "shard", "doc_id", "part", "n_tokens", F.sha2("tokens", 256).alias("tokens_sha256"))


@query("op4_training_order")
def op4_training_order(spark, sf_dir) -> DataFrame:
    return materialised(spark, table(spark, sf_dir, "documents", "doc_id", "text"), sf_dir)
