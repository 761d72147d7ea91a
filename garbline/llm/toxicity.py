"""Toxic passages as maximum-scoring segments of token log-odds.

Learning: on a bounded sample of labelled training documents, every word gets the log-odds
of standing in a toxic rather than a clean document, with a Dirichlet prior that follows the
words' frequencies in both. Words that are surely ten times likelier in toxic documents score
their log-odds, all words pay a small price, so that only neighbourhoods of such words
have positive sums.

Search: a linear-time scan finds all maximal scoring segments of a text. With the score
distribution of clean text, extreme-value theory gives the number of segments of at least a
score that a clean text of the same length would have by chance, ``K n exp(-lambda S)``;
``lambda`` is solved from the distribution, ``K`` is the rate at which segments begin. Segments
expected less than ``SIGNIFICANT`` times are toxic passages. The negative logarithms of their
expected numbers are summed, and a logistic curve fitted on the sample turns the sum
into the score.

NULL, empty and wordless texts have no passage and score as any text without one. Without
both labels in the training sample every score is the share of toxic labels (0 without any).
Rows that repeat are scored alike. Texts are scanned whole, in time linear in their words. Segments of equal sums
begin at the earliest word. An empty table gives an empty result. Other columns are ignored by the query
and kept by ``score_texts``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.llm.common import U64, Words, hash_strings, held_out, labelled_sample, score_texts, slices, table
from garbline.llm.registry import query
from garbline.session import cut_lineage

SAMPLE = 20_000  # labelled documents of each label that a model is fitted on
FLOOR = 0.5  # prior of a word that was never seen
PRIOR = 10.0  # weight of the words' common frequencies in the prior, per thousand words
SURE = 1.5  # standard deviations that log-odds are lowered by before they are judged
LEAST = 2.3  # lowered log-odds from which a word counts: ten times likelier in toxic documents
PRICE = 0.5
SIGNIFICANT = 0.05


def maximal_segments(places: np.ndarray, scores: np.ndarray, price: float = PRICE) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a text whose words cost ``price`` but for those at
    ``places``, which bring ``scores`` (net of the price).

    Every candidate keeps the nearest one before it with a smaller sum, so a search goes from one such to
    the next and passes over what an earlier search has passed over: linear in the number of places.
    """
    found: list[tuple] = []  # first, end, sum before, sum after, nearest candidate with a smaller sum before
    total, end = 0.0, 0
    for place, score in zip(places.tolist(), scores.tolist()):
        total -= price * (place - end)
        first, before = place, total
        total += score
        end = place + 1
        while True:
            at = len(found) - 1
            while at >= 0 and found[at][2] >= before:
                at = found[at][4]
            if at < 0 or found[at][3] >= total:
                break
            first, before = found[at][0], found[at][2]
            del found[at:]
        found.append((first, end, before, total, at))
    return [(first, last, after - before) for first, last, before, after, _ in found]


@dataclass
class ToxicModel:
    hashes: np.ndarray  # ascending word hashes
    scores: np.ndarray
    decay: float = 1.0
    rate: float = 1.0
    slope: float = 0.0
    offset: float = -np.inf

    def passages(self, texts: pa.Array):
        """For each text the significant segments with the negative logarithm of their expected number."""
        words = Words(texts, fold="alnum")
        if not len(words.codes) or not len(self.hashes):
            return [[] for _ in range(len(texts))]
        hashed = hash_strings(words.distinct)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        of_word = np.where(self.hashes[at] == hashed, self.scores[at], 0.0)
        per_place = of_word[words.codes]
        places = np.flatnonzero(per_place > 0)
        cuts = np.searchsorted(places, np.concatenate([words.starts, [len(per_place)]]))
        out = []
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            found = []
            if b > a:
                mine = places[a:b]
                for first, last, score in maximal_segments(mine - words.starts[i], per_place[mine]):
                    unlikely = self.decay * score - np.log(self.rate * words.lengths[i])
                    if unlikely > -np.log(SIGNIFICANT):
                        found.append((first, last, unlikely))
            out.append(found)
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if not np.isfinite(self.offset):
            return np.full(len(evidence), float(self.offset > 0))
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.log1p(evidence), -500, 500)))

    def predict(self, texts: pa.Array):
        found = self.passages(texts)
        evidence = np.array([sum(s for _, _, s in f) for f in found], float)
        spans = [",".join(f"{a}:{b}" for a, b, _ in f) for f in found]
        return pa.array(self.score(evidence)), pa.array([len(f) for f in found], pa.int32()), pa.array(spans, pa.string())


def word_counts(labelled: DataFrame) -> DataFrame:
    """``word`` (a hash), ``toxic``, ``clean``: the numbers of documents of each label (``text``, ``label``) that hold the word."""

    def run(batches):
        for piece in slices(batches, "text", 4 << 20):
            words = Words(piece.column(0), fold="alnum")
            if not len(words.codes):
                continue
            owner = np.repeat(np.arange(len(words.lengths)), words.lengths)
            once = np.unique(owner.astype(np.int64) * len(words.distinct) + words.codes)
            label = piece.column(1).to_numpy(zero_copy_only=False)[once // len(words.distinct)]
            code = once % len(words.distinct)
            toxic, clean = (np.bincount(code[label == v], minlength=len(words.distinct)) for v in (1, 0))
            yield pa.RecordBatch.from_arrays([pa.array(hash_strings(words.distinct).view(np.int64)), pa.array(toxic), pa.array(clean)], names=["word", "toxic", "clean"])

    return labelled.select("text", "label").mapInArrow(run, "word long, toxic long, clean long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def log_odds(counts: DataFrame, sure: float = SURE, least: float = LEAST) -> tuple[DataFrame, dict]:
    """The words whose log-odds surely reach ``least``, with ``odds``; and the sums of all counts."""
    sums = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("words")).first().asDict()
    n_toxic, n_clean = sums["toxic"] or 0, sums["clean"] or 0
    every = max(1, n_toxic + n_clean)
    weight = PRIOR * every / 1000
    prior = F.lit(FLOOR) + (F.col("toxic") + F.col("clean")) / every * min(weight, 1000.0)
    total = FLOOR * (sums["words"] or 0) + min(weight, 1000.0)
    side = lambda c, n: F.log((F.col(c) + prior) / (F.lit(float(n + total)) - F.col(c) - prior))
    odds = side("toxic", n_toxic) - side("clean", n_clean)
    spread = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    return counts.withColumn("odds", odds).where(odds - sure * spread >= least), sums


def decay_of(scores: np.ndarray, shares: np.ndarray, price: float = PRICE) -> float:
    """``lambda``: the positive root of the mean of ``exp(lambda s)`` = 1 over the words of clean text."""
    rest = 1 - shares.sum()
    mean = lambda x: (shares * np.exp(np.minimum(x * scores, 600))).sum() + rest * np.exp(-x * price)
    low, high = 0.0, 1e-3
    while mean(high) < 1 and high < 1e3:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return max(high, 1e-3)


def fit(labelled: DataFrame) -> ToxicModel:
    """A model from ``text`` and ``label``; the rows must be few enough for one fit."""
    counts = cut_lineage(word_counts(labelled), "words")
    surely, sums = log_odds(counts)
    rows = surely.toPandas()
    hashes = rows["word"].to_numpy(np.int64).view(U64)
    order = np.argsort(hashes)
    scores = rows["odds"].to_numpy(float)[order] - PRICE
    model = ToxicModel(hashes[order][scores > 0], scores[scores > 0])
    # half a document more than was seen, so that a word no clean document held keeps a share
    shares = ((rows["clean"].to_numpy(float) + 0.5) / max(1, sums["clean"] or 1))[order][scores > 0]
    if len(model.scores):
        model.decay, model.rate = decay_of(model.scores, shares), min(1.0, float(shares.sum()))
    evidence = lambda texts: (pa.array([sum(s for _, _, s in f) for f in model.passages(texts)], pa.float64()),)
    seen = score_texts(labelled.select("text", "label"), "text", "text string, evidence double", lambda t: (pa.nulls(len(t), pa.string()), *evidence(t)))
    seen = seen.select("label", "evidence").toPandas()
    model.slope, model.offset = logistic(np.log1p(seen["evidence"].to_numpy(float)), seen["label"].to_numpy(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, slightly regularised."""
    if len(y) == 0 or y.min() == y.max():
        return 0.0, (-np.inf if len(y) == 0 or y.max() == 0 else np.inf)
    design, beta = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - np.array([1e-3, 0.0]) * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def learn_from(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> ToxicModel:
    """A model from the sampled labels and their texts; the sample's size bounds what is broadcast."""
    sample = cut_lineage(labelled_sample(labels, "toxic", most), "sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return fit(cut_lineage(texts.join(F.broadcast(sample), "doc_id").select("text", "label"), "labelled"))


def find_toxic(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``n_passages`` and ``passages`` (``first:end`` in words)."""
    return score_texts(docs, text, "score double, n_passages int, passages string", lambda texts: model.predict(texts))


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = learn_from(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    found = find_toxic(docs, model)
    return found.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "passages"
    )
