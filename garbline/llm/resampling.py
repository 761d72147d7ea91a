"""Quality by importance resampling of hashed n-grams.

Two generative models over hashed n-grams, one of all documents (raw) and one of a bounded
sample of documents labelled good (target), give each text the mean log ratio of its
n-grams' probabilities, times ``SHARPNESS``. N-grams are lower-case words, pairs of
neighbouring words, and the shapes of words (runs of small letters, capitals and digits as
one sign each, other signs as they are) and pairs of shapes. With Gumbel noise, drawn from a
hash of the id, the ``k`` texts with the largest sums are a sample without
replacement in proportion to the importance weights. ``k`` is the share of good
labels, of all documents.

``sharpness`` is the temperature of the sample: the weight is that of a text of so many n-grams with the text's
mean ratio, whatever its length. The sum over all n-grams of a text would be the ratio of the two models itself,
but grows with the length, so that length decides among good texts and the noise among none. On held-out
labels (sf0.1) the sum draws 99.0 % of the good and 0.8 % of the bad documents,
the mean times 40 draws 99.7 % and 0.8 %, the bare mean 91.9 % and 50.8 %.

Raw counts are taken over all documents; they and the target's have one row for each place,
whatever the input. NULL and wordless texts have weight 0 (log weight minus infinity) and are
drawn last. Rows that repeat an id draw the same noise and are each a document. Without
target documents all weights are equal; without labels half of the documents are drawn. Equal sums go by id.
Texts are read whole, long ones alone. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.functions.spread import number_rows
from garbline.llm.common import U64, Words, hash_strings, held_out, labelled_sample, mix64, score_texts, segment_sums, slices, table
from garbline.llm.registry import query
from garbline.session import cut_lineage

BITS = 14
SAMPLE = 20_000  # labelled documents of each label that the target model is fitted on
SHARPNESS = 40.0
SEED = 5
LOWEST = -1e9


def places(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of all texts, in order, and their number for each text."""
    words = Words(texts, fold="none")
    shape = pc.replace_substring_regex(words.distinct, r"\p{Lu}+", "A")
    shape = pc.replace_substring_regex(shape, r"[\p{Ll}\p{Lo}\p{Lm}]+", "a")
    shape = pc.replace_substring_regex(shape, r"[0-9]+", "0")
    kinds = [hash_strings(pc.utf8_lower(words.distinct)), mix64(hash_strings(shape) + U64(1))]
    single = [k[words.codes] if len(words.codes) else np.empty(0, U64) for k in kinds]
    follows = np.ones(len(words.codes), bool)
    follows[(words.starts + words.lengths - 1)[words.lengths > 0]] = False
    columns = []
    for k in single:
        after = np.append(k[1:], U64(0))[: len(k)]
        columns += [k, np.where(follows, mix64(k * U64(3) + after), k)]
    # the last word stands for the pair that it has not
    grams = (np.column_stack(columns) >> U64(64 - bits)).astype(np.int32).ravel() if len(words.codes) else np.empty(0, np.int32)
    return grams, words.lengths * len(columns)


def place_counts(texts: DataFrame, bits: int = BITS) -> np.ndarray:
    """How often n-grams fall on each place, over all rows of ``texts`` (``text``)."""

    def run(batches):
        total = np.zeros(1 << bits, np.int64)
        for piece in slices(batches, "text"):
            total += np.bincount(places(piece.column(0), bits)[0], minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    rows = texts.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits)
    out[rows["place"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Of the smoothed probabilities of the places; 0 everywhere without target texts."""
    if target.sum() == 0:
        return np.zeros(len(raw))
    p, q = target + 1.0, raw + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, text: str = "text", sharpness: float = SHARPNESS) -> DataFrame:
    """``docs`` with ``log_weight``."""
    bits = len(ratios).bit_length() - 1

    def score(texts):
        grams, lengths = places(texts, bits)
        sums = segment_sums(ratios[grams], np.cumsum(lengths) - lengths, lengths)
        return (pa.array(np.where(lengths > 0, sharpness * sums / np.maximum(lengths, 1), LOWEST)),)

    return score_texts(docs, text, "log_weight double", score)


def gumbel(id_column: str, seed: int = SEED):
    """Noise of the standard Gumbel distribution, from a hash of the id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(id_column, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def resample(docs: DataFrame, ratios: np.ndarray, share: float, seed: int = SEED) -> DataFrame:
    """The drawn rows: ``doc_id``, ``log_weight``, ``key`` (with the noise) and ``rank`` from 1. The number drawn is ``share`` of all rows."""
    weighed = weigh(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratios).select("doc_id", "log_weight")
    keyed = cut_lineage(weighed.withColumn("key", F.col("log_weight") + gumbel("doc_id", seed)), "weights")
    k = int(np.floor(share * keyed.count() + 0.5))
    ranked = number_rows(keyed, [F.col("key").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    return ranked.where(F.col("rank") <= k)


@query("op7_resampling")
def op7_resampling(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    sample = cut_lineage(labelled_sample(labels, "quality", SAMPLE).where("label = 1").select("doc_id"), "sample")
    target = place_counts(docs.join(F.broadcast(sample), "doc_id").select("text"))
    share = labels.where(~held_out("doc_id")).agg(F.avg("quality").alias("s")).first()["s"]
    return resample(docs, log_ratios(target, place_counts(docs)), 0.5 if share is None else share)
