"""Scores of the classifiers, recomputed word by word with dictionaries from the same rows."""

import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from garbline.llm import language, registry, resampling, toxicity
from garbline.llm.common import hash_strings
from tests.llm.conftest import write_tables

QUERIES = registry.queries()
MASK = (1 << 64) - 1
BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def is_held(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    rng = np.random.default_rng(21)
    stems = {"en": "the of and house water with some bad vile".split(), "de": "der und haus nicht wasser mit eine übel".split(), "fr": "le et maison pas eau avec une mal".split()}
    documents, labels = [], []
    for i in range(240):
        lang = list(stems)[i % 3]
        words = [stems[lang][k] + ("" if rng.random() < 0.7 else str(rng.integers(9))) for k in rng.integers(0, len(stems[lang]), int(rng.integers(0, 40)))]
        toxic, good = int(i % 5 == 0), int(i % 4 != 0)
        if toxic:
            words[len(words) // 2 : len(words) // 2] = ["scum", "Filth,", "scum", "vermin"][: int(rng.integers(2, 5))]
        if not good:
            words = [w.upper() + "!!" for w in words]
        documents.append((i, " ".join(words) if i % 17 else None, lang if i % 11 else None, "s"))
        labels.append((i, good, toxic))
    return write_tables(tmp_path_factory.mktemp("plain"), documents, labels), documents, labels


def lower_words(text):
    return [w for w in BLANKS.split((text or "").lower()) if w]


def test_language_scores(spark, small):
    path, documents, _ = small
    bits = language.BITS

    def places(text):
        for word in lower_words(text):
            raw = f" {word} ".encode()
            for n in range(1, language.NGRAM + 1):
                for at in range(len(raw) - n + 1):
                    yield mix((int.from_bytes(raw[at : at + n], "big") + (n << 56)) & MASK) >> (64 - bits)

    labels = sorted({d[2] for d in documents if d[2] and not is_held(d[0])})
    counts = {lang: {} for lang in labels}
    for doc, text, lang, _ in documents:
        if lang and not is_held(doc):
            for p in places(text):
                counts[lang][p] = counts[lang].get(p, 0) + 1
    every = 1 << bits
    total = {lang: sum(counts[lang].values()) + 0.1 * every for lang in labels}
    share = {lang: [(counts[lang].get(p, 0) + 0.1) / total[lang] for p in range(every)] for lang in labels}
    code = [(1, *s) for s in itertools.product((1, -1), repeat=len(labels) - 1)][1:]
    margins, power = [], []
    for split in code:
        side = {s: [sum(share[lang][p] for lang, t in zip(labels, split) if t == s) / split.count(s) for p in range(every)] for s in (1, -1)}
        weight = [math.log(a / b) for a, b in zip(side[1], side[-1])]
        expected = [sum(f * w for f, w in zip(share[lang], weight)) for lang in labels]
        low, high = min(e for e, t in zip(expected, split) if t > 0), max(e for e, t in zip(expected, split) if t < 0)
        middle, half = (low + high) / 2, max((low - high) / 2, 1e-3)
        mean = [sum(share[lang][p] for lang in labels) / len(labels) for p in range(every)]
        power.append(half / math.sqrt(sum(f * (w - middle) ** 2 for f, w in zip(mean, weight))))
        margins.append((weight, middle, half))
    power = [p / (sum(power) / len(power)) for p in power]
    got = {r["doc_id"]: r for r in QUERIES["op8_language"](spark, path).collect()}
    for doc, text, _, _ in documents:
        r = got[doc]
        assert r["held_out"] == is_held(doc)
        found = list(places(text))
        if not found:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        bit = [(sum(w[p] for p in found) / len(found) - m) / h for w, m, h in margins]
        loss = {lang: sum(p * math.log1p(math.exp(-language.SHARPNESS * b * split[i])) for p, b, split in zip(power, bit, code)) for i, lang in enumerate(labels)}
        best = min(loss, key=loss.get)
        assert r["lang_pred"] == best
        assert r["score"] == pytest.approx(1 / sum(math.exp(loss[best] - x) for x in loss.values()), abs=1e-4)


def shape(word):
    out = re.sub(r"[A-ZÄÖÜ]+", "A", word)
    return re.sub(r"[0-9]+", "0", re.sub(r"[a-zäöüß]+", lambda m: "a", out))


def test_resampling_weights(spark, small):
    path, documents, labels = small

    def places(text):
        words = [w for w in BLANKS.split(text or "") if w]
        out = []
        for kind, salt in ((str.lower, None), (shape, 1)):
            hashes = hash_strings(pa.array([kind(w) for w in words], pa.large_string())).tolist()
            if salt:
                hashes = [mix((h + salt) & MASK) for h in hashes]
            for i, h in enumerate(hashes):
                after = mix((h * 3 + hashes[i + 1]) & MASK) if i + 1 < len(hashes) else h
                out += [h >> (64 - resampling.BITS), after >> (64 - resampling.BITS)]
        return out

    good = {d for d, q, _ in labels if q == 1 and not is_held(d)}
    target, raw = np.ones(1 << resampling.BITS), np.ones(1 << resampling.BITS)
    for doc, text, _, _ in documents:
        for p in places(text):
            raw[p] += 1
            target[p] += doc in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    rows = QUERIES["op7_resampling"](spark, path).collect()
    known = [q for d, q, _ in labels if not is_held(d)]
    assert len(rows) == int(sum(known) / len(known) * len(documents) + 0.5)
    texts = {d[0]: d[1] for d in documents}
    for r in rows:
        found = places(texts[r["doc_id"]])
        want = resampling.SHARPNESS * sum(ratio[p] for p in found) / len(found) if found else resampling.LOWEST
        assert r["log_weight"] == pytest.approx(want, abs=1e-6)
    # the drawn are those with the largest sums of weight and noise
    noise = {r["doc_id"]: r["g"] for r in spark.createDataFrame([(d[0],) for d in documents], "doc_id long").select("doc_id", resampling.gumbel("doc_id").alias("g")).collect()}
    sums = {}
    for doc, text, _, _ in documents:
        found = places(text)
        sums[doc] = (resampling.SHARPNESS * sum(ratio[p] for p in found) / len(found) if found else resampling.LOWEST) + noise[doc]
    assert {r["doc_id"] for r in rows} == set(sorted(sums, key=sums.get, reverse=True)[: len(rows)])


def test_toxicity_scores(spark, small):
    path, documents, labels = small
    toxic = {d: t for d, _, t in labels if not is_held(d)}

    def words(text):
        return [w for w in ("".join(c for c in w if c.isalnum()) for w in lower_words(text)) if w]

    counts = {}
    for doc, text, _, _ in documents:
        if doc in toxic:
            for w in set(words(text)):
                counts.setdefault(w, [0, 0])[1 - toxic[doc]] += 1
    n = [sum(c[k] for c in counts.values()) for k in (0, 1)]
    weight = min(toxicity.PRIOR * max(1, sum(n)) / 1000, 1000.0)
    total = toxicity.FLOOR * len(counts) + weight
    scores, shares = {}, {}
    for w, (t, c) in counts.items():
        prior = toxicity.FLOOR + (t + c) / max(1, sum(n)) * weight
        odds = math.log((t + prior) / (n[0] + total - t - prior)) - math.log((c + prior) / (n[1] + total - c - prior))
        if odds - toxicity.SURE * math.sqrt(1 / (t + prior) + 1 / (c + prior)) >= toxicity.LEAST:
            scores[w], shares[w] = odds - toxicity.PRICE, (c + 0.5) / max(1, n[1])
    assert {"scum", "filth"} <= set(scores)
    names = list(scores)
    decay = toxicity.decay_of(np.array([scores[w] for w in names]), np.array([shares[w] for w in names]))
    rate = min(1.0, sum(shares.values()))

    def segments(values):
        """By definition: the best stretch, then those left and right of it."""
        best = max(((sum(values[a:b]), -(b - a), -a, a, b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=None)
        if best is None or best[0] <= 1e-12:
            return []
        a, b = best[3], best[4]
        return segments(values[:a]) + [best[0]] + segments(values[b:])

    evidence = {}
    for doc, text, _, _ in documents:
        found = words(text)
        unlikely = [decay * s - math.log(rate * len(found)) for s in segments([scores.get(w, -toxicity.PRICE) for w in found])]
        evidence[doc] = math.log1p(sum(u for u in unlikely if u > -math.log(toxicity.SIGNIFICANT)))
    known = sorted(toxic)
    slope, offset = toxicity.logistic(np.array([evidence[d] for d in known]), np.array([float(toxic[d]) for d in known]))
    for r in QUERIES["op2_toxicity"](spark, path).collect():
        want = 1 / (1 + math.exp(-max(-500, min(500, offset + slope * evidence[r["doc_id"]]))))
        assert r["score"] == pytest.approx(want, abs=1e-6) and r["predicted"] == int(r["score"] >= 0.5)
