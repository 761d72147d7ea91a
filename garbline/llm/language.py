"""Language identification by error-correcting output codes over character n-grams.

Every language gets a codeword of signs. For each bit, a binary classifier over hashed byte
n-grams of the lower-case words (each word between two spaces, 1 to 4 bytes) tells the
languages of one sign from those of the other: its weights are the log ratios of the n-gram
frequencies of the two sides, counted over all training documents, and its margin is the
mean weight of a text's n-grams, shifted and scaled so that -1 and 1 are what texts of the
two sides give. Decoding sums, for each codeword, the logistic losses of the bits,
weighted by how well the bit separates its sides. The codeword with the least loss wins; a
text whose two best codewords are nearly as close is flagged as ambiguous.

Training counts have one row for each language and n-gram place at most, however large the
input. NULL texts and texts without a letter get ``und``, as does everything when there is no
training document. Ties go to the language that sorts first. Rows that repeat are
scored alike. Texts are read whole, long ones alone. An empty table gives an empty result. A task holds one array
of 64 KB for each language that it meets while learning, so some thousands of languages fit. In
``speakable`` all columns of the input, whatever their names, stay as they are.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.llm.common import U64, Words, absent_name, held_out, mix64, score_texts, segment_sums, slices, table
from garbline.llm.registry import query

BITS = 13
NGRAM = 4
# Losses of the two best codewords nearer than this (as a share of all bit weights) are ambiguous.
AMBIGUOUS = 0.02
SHARPNESS = 4.0
UNKNOWN = "und"


def ngrams(words: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of the byte n-grams of the words, and the number of the word each belongs to."""
    padded = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    offsets = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset : padded.offset + len(padded) + 1]
    raw = np.frombuffer(padded.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(U64)
    owner = np.repeat(np.arange(len(padded)), np.diff(offsets))
    places, owners = [], []
    window = np.zeros(len(raw), U64)
    for n in range(1, NGRAM + 1):
        window = (window[: len(raw) - n + 1] << U64(8)) | raw[n - 1 :]
        same = owner[: len(window)] == owner[n - 1 :]
        places.append((mix64(window[same] + (U64(n) << U64(56))) >> U64(64 - bits)).astype(np.int64))
        owners.append(owner[: len(window)][same])
    return np.concatenate(places), np.concatenate(owners)


def count_ngrams(labelled: DataFrame, text: str, label: str, bits: int = BITS) -> DataFrame:
    """``label``, ``place``, ``n``: how often the texts of each label hold n-grams of each place."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for piece in slices(batches, "text"):
            words = Words(piece.column(0), fold="utf8")
            if not len(words.codes):
                continue
            places, owners = ngrams(words.distinct, bits)
            labels = piece.column(1).dictionary_encode()
            of_word = np.repeat(labels.indices.to_numpy(zero_copy_only=False), words.lengths)
            for i, name in enumerate(labels.dictionary.to_pylist()):
                often = np.bincount(words.codes[of_word == i], minlength=len(words.distinct))
                found = np.bincount(places, weights=often[owners], minlength=1 << bits).astype(np.int64)
                totals[name] = totals.get(name, 0) + found
        for name, found in totals.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(found[at])], names=["label", "place", "n"])

    counted = labelled.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    return counted.mapInArrow(run, "label string, place long, n long").groupBy("label", "place").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """A sign matrix with a row for each of ``n`` classes: all ways to split up to seven classes, else
    the best of some fixed random codes of ``10 log2 n`` bits."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        splits = [(1, *s) for s in itertools.product((1, -1), repeat=n - 1)][1:]
        return np.array(splits, float).T
    rng, length = np.random.default_rng(20), int(np.ceil(10 * np.log2(n)))
    best, least = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, length))
        code[:, np.abs(code.sum(0)) == n] *= np.where(np.arange(n) % 2, 1.0, -1.0)[:, None]
        apart = (length - code @ code.T) / 2 + length * np.eye(n)
        if apart.min() > least:
            best, least = code, apart.min()
    return best


@dataclass
class LanguageModel:
    labels: list[str]
    code: np.ndarray  # labels x bits, signs
    weights: np.ndarray  # n-gram places x bits, already shifted and scaled
    bit_weights: np.ndarray
    places: int

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The index of the nearest codeword, its score and whether the choice is ambiguous, by row."""
        signed = margins[:, None, :] * self.code[None, :, :]
        losses = (np.logaddexp(0, -SHARPNESS * signed) * self.bit_weights).sum(2)
        best = losses.argmin(1)
        ordered = np.sort(losses, 1)
        gap = (ordered[:, 1] - ordered[:, 0]) if len(self.labels) > 1 else np.full(len(losses), np.inf)
        share = np.exp(ordered[:, :1] - losses).sum(1)
        return best, 1.0 / share, gap < AMBIGUOUS * SHARPNESS * self.bit_weights.sum()

    def _word_sums(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The summed weights and the number of the n-grams of each word."""
        places, owners = ngrams(words, self.places)
        count = np.bincount(owners, minlength=len(words))
        # n-grams come length by length: bring those of a word together
        ordered = self.weights[places[np.argsort(owners, kind="stable")]]
        return segment_sums(ordered, np.cumsum(count) - count, count), count

    def predict(self, texts: pa.Array):
        words = Words(texts, fold="utf8")
        if len(words.codes):
            parts = [self._word_sums(words.distinct.slice(i, 16384)) for i in range(0, len(words.distinct), 16384)]
            of_word, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            sums = segment_sums(of_word[words.codes], words.starts, words.lengths)
            total = segment_sums(count[words.codes], words.starts, words.lengths)
        else:
            sums, total = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts))
        best, score, doubtful = self.decode(sums / np.maximum(total, 1)[:, None])
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        names = np.array(self.labels, object)[best]
        return (
            pa.array(np.where(lettered, names, UNKNOWN), pa.string()),
            pa.array(np.where(lettered, score, 0.0)),
            pa.array(np.where(lettered, doubtful, True)),
        )


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", bits: int = BITS) -> LanguageModel | None:
    """Learn from all rows of ``labelled`` with a label; None without any n-gram."""
    rows = count_ngrams(labelled.where(F.col(label).isNotNull()), text, label, bits).toPandas()
    if rows.empty:
        return None
    labels = sorted(rows["label"].unique())
    counts = np.zeros((len(labels), 1 << bits))
    counts[rows["label"].map({x: i for i, x in enumerate(labels)}), rows["place"]] = rows["n"]
    # languages weigh alike, whatever the number of their documents
    frequency = (counts + 0.1) / (counts + 0.1).sum(1, keepdims=True)
    code = codewords(len(labels))
    if len(labels) == 1:
        return LanguageModel(labels, code, np.zeros((1 << bits, 1), np.float32), np.ones(1), bits)
    sides = [(code == s).astype(float).T @ frequency / (code == s).sum(0)[:, None] for s in (1, -1)]
    weights = np.log(sides[0] / sides[1]).T
    expected = frequency @ weights  # labels x bits
    low = np.where(code > 0, expected, np.inf).min(0)
    high = np.where(code < 0, expected, -np.inf).max(0)
    middle, half = (low + high) / 2, np.maximum((low - high) / 2, 1e-3)
    # the shift can ride on each n-gram, as margins are means over the n-grams
    spread = np.sqrt((frequency.mean(0)[:, None] * (weights - middle) ** 2).sum(0))
    return LanguageModel(labels, code, ((weights - middle) / half).astype(np.float32), half / spread / (half / spread).mean(), bits)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "ambiguous": F.lit(True)})
    return score_texts(docs, text, "lang_pred string, score double, ambiguous boolean", lambda texts: model.predict(texts))


def learn_from(docs: DataFrame) -> LanguageModel | None:
    return fit(docs.where(~held_out("doc_id")))


@query("op8_language")
def op8_language(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn_from(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def speakable(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in none of the learned languages go. The rest keep all their columns.

    Those flagged as ambiguous stay: they hold words of a learned language.
    """
    model, found = learn_from(docs), absent_name(docs, "lang_pred")
    if model is None:
        return docs.limit(0)
    scored = score_texts(docs, "text", f"`{found}` string", lambda texts: model.predict(texts)[:1])
    return scored.where(F.col(found) != UNKNOWN).select(*docs.columns)
