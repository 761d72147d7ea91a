"""Odd tables through every operator, and the operators' own interfaces."""

import collections
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from garbline.functions.graph import components
from garbline.llm import (
    common, decontamination, fingerprints, language, mixing, ngram_join, personal, registry, resampling, secrets, tagger, toxicity, training_order,
)
from garbline.llm.common import Words, hash_strings, in_bitmap, slices, sparse_counts
from garbline.session import scratch_path
from tests.llm.conftest import LONG, ODD, write_tables
from tests.llm.test_contracts import brute_components, shingles

QUERIES = registry.queries()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, key):
    assert QUERIES[key](spark, empty_dir).collect() == []


def test_odd_rows(spark, odd_dir):
    rows = lambda key: QUERIES[key](spark, odd_dir).collect()
    n = len(ODD)
    mixed = rows("op1_mixing")
    assert len(mixed) == n and all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)
    toxic = rows("op2_toxicity")
    assert len(toxic) == n and all(0 <= r["score"] <= 1 for r in toxic)
    groups = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows("op3_ngram_join")}
    assert groups[(1, 0)] == 1 and groups[(2, 0)] == 2 and groups[(3, 0)] == 3 and groups[(4, 1)] == 4
    cat = len(shingles(ODD[4][1]))
    assert groups[(5, cat)] == 5 and groups[(6, cat)] == 5
    assert len(rows("op5_personal")) == n
    assert {(r["doc_id"], r["item_id"]) for r in rows("op6_decontamination")} == {(5, 1), (6, 1), (10, None)}
    assert 0 < len(rows("op7_resampling")) <= n
    langs = {r["doc_id"]: r["lang_pred"] for r in rows("op8_language")}
    assert langs[1] == langs[2] == langs[3] == langs[9] == "und" and langs[10] != "und"
    prints = rows("op9_fingerprints")
    assert sorted(r["doc_id"] or 0 for r in prints) == [0, 0, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8, 9, 10, 11]
    assert all((r["edited_sha256"] is None) == (r["near_next"] is None) == (r["edited_fingerprint"] is None) == (r["doc_id"] is None) for r in prints)
    assert {r["fingerprint"] for r in prints if r["doc_id"] in (1, 2, 3)} == {"0" * 32}
    assert len(rows("op10_secrets")) == n
    slots = rows("op4_training_order")
    assert sorted(r["slot"] for r in slots) == list(range(len(slots)))
    assert {r["doc_id"] for r in slots} == {None, 3, 4, 5, 6, 7, 8, 9, 10, 11}


def test_pipeline_on_empty_tables(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_encoding_of_long_blanks(monkeypatch):
    """Runs that the library's pattern gives up on, and equality with the library where it does not."""
    tokenizer = training_order.encoding(Path(training_order.VOCABULARY).read_bytes())
    for text in [" " * 5_000_000, "a" + " \n" * 1_500_000 + " b", "x" * 1_000_000]:
        assert tokenizer.decode(training_order.encode(text, tokenizer).tolist()) == text
    monkeypatch.setattr(training_order, "LONG_BLANK", re.compile(training_order.LONG_BLANK.pattern.replace("10000", "3")))
    rng = np.random.default_rng(5)
    parts = ["a", " ", "   ", "\n\n\n\n", "\t", "      ", "\u00e9", "1", "'s", "\u3000" * 3, "!", "\x1c" * 4]
    for _ in range(500):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), int(rng.integers(0, 12))))
        assert training_order.encode(text, tokenizer).tolist() == tokenizer.encode_ordinary(text)


def test_pipeline_stages_keep_the_columns(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    names = docs.columns
    whole = collections.Counter(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd_dir)
        assert docs.columns == names, name
        # every row that stays is a row of the documents, whatever its columns are called
        assert all(tuple(r) in whole for r in docs.collect()), name
    left = {r["doc_id"] for r in docs.collect()}
    assert left <= {4, None, 5, 7, 8, 11}
    assert corpus_pipeline.run(spark, odd_dir).count() > 0


def test_pipeline_against_brute_force(spark, small_dir, texts):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language ID"](spark, docs, small_dir)
    assert {r["doc_id"] for r in spoken.collect()} == {d for d, t in texts.items() if t and any(c.isalpha() for c in t)}
    single = stages["n-gram Jaccard join"](spark, docs, small_dir)
    _, least = brute_components(texts)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(least.values()))
    clean = stages["benchmark decontamination"](spark, docs, small_dir)
    found = {r["doc_id"] for r in QUERIES["op6_decontamination"](spark, small_dir).collect()}
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - found and found
    mix = stages["source mixing"](spark, docs, small_dir).groupBy("doc_id").count().collect()
    plan = {r["doc_id"]: r["passes"] for r in mixing.mix(docs).collect()}
    assert {r["doc_id"]: r["count"] for r in mix} == {d: n for d, n in plan.items() if n}


# n-gram join


def near_copies(copies, seed=1, words=60):
    """Copies of one text with one to six changed words each, and texts made of two common passages."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(copies):
        text = list(base)
        for at in rng.integers(0, words, int(rng.integers(1, 3))):
            text[at] = f"x{rng.integers(10**6)}"
        out.append((i, " ".join(text), "en", "s"))
    passages = [" ".join(f"p{k}_{i}" for i in range(12)) for k in range(6)]
    for i in range(copies):
        a, b = rng.integers(0, 6, 2)
        out.append((copies + i, f"{passages[a]} y{rng.integers(3)} {passages[b]}", "en", "s"))
    return out


@pytest.mark.parametrize(("light", "rounds"), [(32, 4), (3, 0), (2, 1), (4, 2)])
def test_ngram_join_on_long_lists(spark, tmp_path, light, rounds):
    rows = near_copies(45)
    path = write_tables(tmp_path, rows)
    sets, want = brute_components({r[0]: r[1] for r in rows})
    found = ngram_join.near_duplicates(spark.read.parquet(f"{path}/documents.parquet"), light=light, rounds=rounds)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == want


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_bound_holds_for_every_partner_of_a_list(spark, percent):
    shared = lambda a, b: -(-percent * (a + b) // (100 + percent)) + 1 - ngram_join.need(max(a, b), percent)
    rows = [(n, low, high) for n in range(20, 400, 3) for low in (n - 9, n) for high in range(n, 100 * n // percent + 3, 2)]
    bound = ngram_join._least_with_any("low", "high", percent)
    least = lambda n, low, high: min(shared(n, x) for x in range(max(low, ngram_join.need(n, percent)), min(high, 100 * n // percent) + 1))
    for r in spark.createDataFrame(rows, "n int, low int, high int").selectExpr("n", "low", "high", f"{bound} as bound").collect():
        want = least(r["n"], r["low"], r["high"])
        assert want - 1 <= r["bound"] <= want, r


def test_sets_that_may_link_stay_in_long_lists(spark):
    # 100 grams need to share 8 first grams with 104, but 9 with 105
    sizes = {1: 100, 2: 104, 3: 105}
    schema = "sig long, cls long, n int, later array<struct<cls:long,n:int>>"
    met = spark.createDataFrame([(2 * k + 1, c, n, None) for k in range(8) for c, n in sizes.items()], schema)
    left = ngram_join.able_to_link(met, 80, 1)
    assert {r["cls"] for r in left.select("cls").distinct().collect()} >= {1, 2}


def test_boundary_by_cost():
    assert ngram_join.boundary({}, 0.0) == 1
    # long lists make enumerating worth while for larger sets
    few, many = (ngram_join.boundary({n: 10 for n in range(1, 100)}, m) for m in (0.1, 50.0))
    assert few < many


def test_need_is_tight():
    for n in range(1, 60):
        partners = [(m, k) for m in range(n, 90) for k in range(n + 1) if 100 * k >= 80 * (n + m - k)]
        assert min(k for _, k in partners) >= ngram_join.need(n)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (6, 5), (7, 7), *[(20 + i, 21 + i) for i in range(40)]], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {20 + i: 20 for i in range(41)}


# words and hashes


def test_words_split_on_ascii_white_space_only():
    texts = pa.array(["  a\tb\nc d\x1ce \x0b f", None, "", "\n", "A B"])
    words = Words(texts)
    got = [words.distinct[int(c)].as_py() for c in words.codes]
    assert got == ["a", "b", "c d\x1ce", "f", "a", "b"] and words.lengths.tolist() == [4, 0, 0, 0, 2]


def test_words_do_not_depend_on_the_slices():
    rng = np.random.default_rng(12)
    texts = pa.array([None if i % 17 == 0 else " ".join(f"W\u00f6rt{rng.integers(50)}" for _ in range(int(rng.integers(0, 40)))) for i in range(300)])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    for fold in ("ascii", "utf8", "alnum", "none"):
        whole = Words(texts, fold).hashes().tolist()
        cut = [h for piece in slices(iter([batch]), "text", 500) for h in Words(piece.column(0), fold).hashes().tolist()]
        direct = [h for i in range(0, 300, 7) for h in Words(texts.slice(i, 7), fold).hashes().tolist()]
        assert cut == whole and direct == whole


def test_hashes_do_not_depend_on_the_array():
    values = pa.array(["", "a", "ab", "b", "a" * 500, "é"])
    whole = hash_strings(values)
    assert len(set(whole.tolist())) == 6
    assert hash_strings(values.slice(2, 3)).tolist() == whole[2:5].tolist()


def test_bitmap(spark):
    values = np.array([0, 1, -1, 2**62, -(2**62)], np.int64)
    df = spark.createDataFrame([(int(v),) for v in values], "h long")
    from pyspark.sql import functions as F

    bitmap = sparse_counts(df, F.col("h"), 12)
    assert in_bitmap(bitmap, values.view(np.uint64)).all()
    assert in_bitmap(bitmap, np.arange(1, 1000, dtype=np.uint64) << np.uint64(53)).mean() < 0.01


# secrets


def test_secret_linking(spark):
    far = "z " * 150
    key, blob = "KX12345678ABCDEF", "abCD1234efGH5678ijKL9012"
    texts = [
        f"{key} and {blob}", f"{key} {far} {blob}", f"only {key}", f"only {blob}", "login: bob password: tiny1", "password: tiny1",
        f"ssh://host.example/x {blob}", f"{key} {'z' * 150} {blob} {'z' * 150} {key}",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["id"]: [(secrets.KINDS[s["rank"]], texts[r["id"]][s["start"] : s["end"]]) for s in r["linked"]] for r in secrets.find_secrets(docs).collect()}
    assert got[0] == [("keyid", key), ("blob", blob)]
    assert got[1] == got[2] == got[3] == got[5] == []
    assert got[4] == [("login", "login: bob"), ("value", "password: tiny1")]
    assert got[6] == [("endpoint", "ssh://host.example/x"), ("blob", blob)]
    assert got[7] == [("keyid", key), ("blob", blob), ("keyid", key)]


def test_linking_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    pieces = ["KX12345678ABCDEF", "abCD1234efGH5678ijKL9012", "ssh://h/x", "login=bob", "pwd=abcd", "z" * 40, "z" * 130, "AKIA" + "B" * 16]
    texts = [" ".join(pieces[i] for i in rng.integers(0, len(pieces), 30)) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    scanned = {r["id"]: r for r in secrets.scan(docs).collect()}
    for r in secrets.find_secrets(docs).collect():
        every = [*scanned[r["id"]]["base"], *scanned[r["id"]]["weak"]]
        role = lambda s: secrets.ROLES[secrets.KINDS[s["rank"]]]
        want = [
            w for w in scanned[r["id"]]["weak"]
            if any(role(p) in secrets.PARTNERS[role(w)] and max(p["start"] - w["end"], w["start"] - p["end"]) <= secrets.SCOPE for p in every)
        ]
        assert set(map(tuple, want)) == set(map(tuple, r["linked"]))


@pytest.mark.parametrize("scope", [50, 200])
def test_linking_of_long_parts_equals_all_pairs(spark, scope):
    rng = np.random.default_rng(6)
    blob = lambda n: "aB3" * (n // 3)
    texts = [
        f"{blob(600)} login: bob", f"login: bob {blob(600)}", f"https://host/{'p/' * 400} pwd: abcd", f"password={'7f' * 256} login: bob",
        f"https://host/{'p/' * 400} {'z ' * 101}pwd: abcd", f"{blob(600)} {'z' * 187} login=bob", "login=bob " + "z " * 60 + "pwd=abcd",
    ]
    parts = [lambda n: blob(n + 21), lambda n: "https://h/" + "p/" * n, lambda n: "login=" + "b" * (n + 3), lambda n: "pwd=" + "c" * (n + 4), lambda n: "z" * n]
    texts += [" ".join(parts[int(k)](int(n)) for k, n in zip(rng.integers(0, 5, 12), rng.integers(0, 500, 12))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    scanned = {r["id"]: r for r in secrets.scan(docs).collect()}
    role = lambda s: secrets.ROLES[secrets.KINDS[s["rank"]]]
    for r in secrets.find_secrets(docs, scope=scope).collect():
        every = [*scanned[r["id"]]["base"], *scanned[r["id"]]["weak"]]
        near = lambda w: any(role(p) in secrets.PARTNERS[role(w)] and max(p["start"] - w["end"], w["start"] - p["end"]) <= scope for p in every)  # noqa: B023, E731
        assert r["linked"] == [w for w in scanned[r["id"]]["weak"] if near(w)]
        if r["id"] < 3:
            assert len(r["linked"]) == 2


def test_weak_parts_over_base_spans(spark):
    run, key = "0123456789abcdef0", "AKIA" + "B7" * 8
    texts = [
        f"https://api.host/v1/{run} password: hunter2", f"https://api.host/?k:{key} pwd: hunter2", f"login: bob_{run}",
        f"secret={run}", f"api_key=KX12345678ABCDEF {'z' * 9}", f"https://h/?token={run}&{'z/' * 200} pwd: hunter2",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["id"]: [(secrets.KINDS[s["rank"]], texts[r["id"]][s["start"] : s["end"]]) for s in r["linked"]] for r in secrets.find_secrets(docs).collect()}
    assert got[0] == [("endpoint", f"https://api.host/v1/{run}"), ("value", "password: hunter2")]
    assert got[1] == [("endpoint", f"https://api.host/?k:{key}"), ("value", "pwd: hunter2")]
    assert got[2] == [("login", f"login: bob_{run}")]
    # the same span seen again, or part of one
    assert got[3] == got[4] == []
    assert got[5] == [("endpoint", f"https://h/?token={run}&{'z/' * 200}"), ("value", "pwd: hunter2")]


# fingerprints


def test_within_radius(spark):
    rng = np.random.default_rng(3)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(30)]
    values = [v ^ sum(1 << int(b) for b in rng.choice(128, k, replace=False)) for v in base for k in (0, 1, 3, 4)] + base[:5]
    half = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    rows = [(i, half(v >> 64), half(v & ((1 << 64) - 1))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, high long, low long")
    got = {r["id"]: r["n_within"] for r in fingerprints.within(df, df).collect()}
    assert got == {i: sum((v ^ w).bit_count() <= 3 for w in values) - 1 for i, v in enumerate(values)}


@pytest.mark.parametrize(("radius", "near"), [(0, 1), (2, 6), (3, 11)])
def test_within_wider_radius(spark, radius, near):
    rng = np.random.default_rng(5)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(12)]
    # bits turned anywhere, and packed into one block
    turns = [rng.choice(size, k, replace=False) for k in (0, 1, 2, 3, 6, 7, 9, 11, 12) for size in (128, 32)]
    values = [v ^ sum(1 << int(b) for b in bits) for v in base for bits in turns]
    half = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    df = spark.createDataFrame([(i, half(v >> 64), half(v & ((1 << 64) - 1))) for i, v in enumerate(values)], "id int, high long, low long")
    got = {r["id"]: (r["n_within"], r["n_near"]) for r in fingerprints.within(df, df, radius, near).collect()}
    count = lambda v, most: sum((v ^ w).bit_count() <= most for w in values) - 1
    assert got == {i: (count(v, radius), count(v, near)) for i, v in enumerate(values)}


def test_lists_of_frequent_grams_are_dealt_out(spark):
    """Near copies whose counted grams are all frequent need uncounted ones; their long lists are marked too."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(400):
        copy = list(base)
        for at in rng.choice(120, 2, replace=False):
            copy[at] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(60)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = docs.select("text")
    bitmap, _ = ngram_join.frequent_grams(found, 5, 60_000)
    entries = ngram_join.signatures(found, 5, 80, bitmap, 4).groupBy("sig").agg(F.count("*").alias("sets"), F.bool_and("late").alias("all"), F.bool_or("late").alias("any"))
    told = entries.collect()
    assert all(r["all"] == r["any"] for r in told)
    long = [r for r in told if r["sets"] > ngram_join.LIGHT]
    assert long and all(r["any"] for r in long)
    sets, groups = brute_components(dict(enumerate(texts)))
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()} == groups


def test_near_copies_are_within_the_wider_radius(spark, tmp_path):
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 10))))
    rows, edited = [], {}
    for words, edits in [(100, 1), (200, 1), (200, 2), (500, 3)]:
        for _ in range(30):
            text = [word() for _ in range(words)]
            copy = list(text)
            for at in rng.choice(words, edits, replace=False):
                copy[at] = word()
            rows += [(100 * len(rows), " ".join(text), "en", "s"), (100 * len(rows) + 1, " ".join(copy), "en", "s")]
            edited[rows[-2][0]] = (words, edits)
    docs = QUERIES["op9_fingerprints"](spark, write_tables(tmp_path, rows)).collect()
    by_id = {r["doc_id"]: r for r in docs}
    share = lambda name, kind: np.mean([by_id[d][name] > 0 for d, k in edited.items() if k == kind])
    recall = {kind: (share("n_within", kind), share("n_near", kind)) for kind in set(edited.values())}
    assert all(near >= 0.8 for _, near in recall.values()), recall
    assert all(by_id[d]["n_near"] <= 1 for d in edited)


# mixing


def test_mixed_rows_keep_their_other_columns(spark):
    """Rows equal in id, source and text but not in another column are rows of their own."""
    rows = [(1, "one two three", "a", f"x{i}") for i in range(5)] + [(2, "four five six", "b", "y")] * 3 + [(3, "seven", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    plan = {}
    for r in mixing.mix(docs).collect():
        plan[r["row"]] = plan.get(r["row"], 0) + r["passes"]
    key = {tuple(r)[:-1]: r["k"] for r in docs.withColumn("k", common.row_key(*docs.columns)).collect()}
    got = collections.Counter(map(tuple, mixing.mixed(spark, docs, "").collect()))
    assert got == collections.Counter({row: plan[k] for row, k in key.items() if plan[k]})


def test_mix_is_spread_and_exact(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("w" * 3 for _ in range(int(rng.integers(0, 400)))), "en", f"s{i % 7}" if i % 3 else "hot") for i in range(600)]
    docs = spark.read.parquet(write_tables(tmp_path, rows) + "/documents.parquet")
    mixed = mixing.mix(docs, block=64).toPandas()
    sums = mixed.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(sums["taken"] - sums["target"]) <= 0.5).all() and (mixed["taken"] <= 3 * mixed["size"]).all()
    assert mixed["taken"].sum() == pytest.approx(mixed["size"].sum(), abs=len(sums))
    # shares by weight where no source is at its limit
    level = (sums["target"] / ((np.arange(len(sums)) % 3) + 1))[sums["target"] < 3 * sums["size"]]
    assert level.max() - level.min() < 1e-6
    # any stretch of the schedule holds about its share of each source
    shared = mixing.shares(mixing.sizes(docs)).cache()
    slots = mixing.schedule(spark, shared, int(mixed["size"].sum()), 64).toPandas().sort_values("slot")
    part = slots.head(len(slots) // 3).groupby("source")["take"].sum()
    assert (abs(part - sums["target"] / 3) <= 64 * 6).all()


# training order


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 17, 256, 257, 5000):
        slots = training_order.slots_of(np.arange(n), n)
        assert sorted(slots.tolist()) == list(range(n))
    a, b = (training_order.slots_of(np.arange(5000), 5000, key) for key in (1, 2))
    assert (a != b).mean() > 0.99 and abs(np.corrcoef(a, np.arange(5000))[0, 1]) < 0.1


def test_shards_round_trip(spark, small_dir, texts):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    shards = training_order.in_training_order(docs, scratch_path(spark, "shards"), length=128, stride=100)
    rows = shards.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    assert all(len(r["tokens"]) == 256 and r["shard"] == r["slot"] // 100 for r in rows)
    parts = {}
    for r in rows:
        parts.setdefault(r["doc_id"], {})[r["part"]] = np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]]
    decode = training_order.encoding(Path(training_order.VOCABULARY).read_bytes()).decode
    for d, text in texts.items():
        if text:
            tokens = np.concatenate([parts[d][k] for k in range(len(parts[d]))])
            assert tokens[-1] == training_order.END and decode(tokens[:-1].tolist()) == text
    again = training_order.read_from(shards, 150, 120, stride=100).collect()
    assert [r["slot"] for r in again] == list(range(150, 270))


# decontamination


def test_edited_passages_are_found(spark, tmp_path):
    item = [f"w{i}" for i in range(24)]
    swap = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(item))
    docs = [
        (1, "a b c " + swap(), "en", "s"), (2, swap(5) + " x", "en", "s"), (3, "x " + swap(4, 9, 15, 20), "en", "s"),
        (4, " ".join(item[:9]), "en", "s"), (5, " ".join(reversed(item)), "en", "s"), (6, swap(*range(0, 24, 2)), "en", "s"),
        (7, f"{LONG[:3000]} {swap(11).upper()}!", "en", "s"),
    ]
    path = write_tables(tmp_path, docs, benchmark=[(8, " ".join(item))])
    got = {r["doc_id"]: r["equal_words"] for r in QUERIES["op6_decontamination"](spark, path).collect()}
    assert got == {1: 24, 2: 23, 3: 20, 7: 23}


def test_best_stretch():
    found = decontamination.best_stretch(np.array([0, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0, 1], bool))
    assert found == (1, 9, 7)


# language


def test_codewords_differ():
    for n in (2, 3, 5, 7, 12, 40):
        code = language.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert (apart[~np.eye(n, dtype=bool)] > 0).all() and (abs(code.sum(0)) < n).all()


def test_many_languages(spark):
    rng = np.random.default_rng(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(9):
        some = [letters[i] for i in rng.choice(26, 7, replace=False)]
        rows += [(f"l{k}", " ".join("".join(rng.choice(some, 5)) for _ in range(40))) for _ in range(12)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = language.fit(df)
    assert len(model.labels) == 9 and model.code.shape[1] > 20
    got = language.identify(df, model).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97


# toxicity


def test_decontamination_against_every_diagonal(spark, tmp_path):
    """Both ways: an overlap is a diagonal with a whole mask on it and enough equal words; short items stand as they are."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(30)]
    draw = lambda n: [vocabulary[i] for i in rng.integers(0, 30, n)]
    items = [" ".join(draw(int(n))) for n in rng.integers(7, 40, 12)] + ["Alpha, beta!", "gamma", "alpha beta delta eps zeta eta", "\u6771\u4eac\u90fd \u306f", "\u5927\u962a" * 9, "", " ... "]
    items += [items[0].upper(), items[3]]
    texts = []
    for i in range(60):
        words = draw(int(rng.integers(0, 120)))
        if i % 2:
            copy = items[int(rng.integers(len(items)))].split()
            for at in rng.integers(0, max(1, len(copy)), len(copy) // 8 if copy else 0):
                copy[at] = "changed"
            words[len(words) // 2 : len(words) // 2] = copy
        texts.append(" ".join(words))
    texts += ["x alpha  BETA y gamma", "\u79c1\u306f\u6771\u4eac\u90fd\u306f\u597d\u304d", "\u5927\u962a" * 12, "alpha", ""]

    def words_of(text):
        spaced = "".join(f" {c} " if "\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" else c for c in text.lower())
        return ["".join(c for c in w if c.isalnum()) for w in spaced.split() if any(c.isalnum() for c in w)]

    want = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            a, b = words_of(text), words_of(item)
            masks = list(decontamination.MASKS) if len(b) >= decontamination.SHORTEST else ["1" * len(b)] if b else []
            for shift in range(-len(b) + 1, len(a)):
                same = np.array([0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))], bool)
                seeded = any(at + shift >= 0 and at + shift + len(m) <= len(a) and all(same[at + k] for k, c in enumerate(m) if c == "1") for m in masks for at in range(len(b) - len(m) + 1))
                if seeded and decontamination.best_stretch(same)[2] >= min(decontamination.MIN_EQUAL, len(b)):
                    want.add((d, i))
    path = write_tables(tmp_path, [(d, t, "en", "s") for d, t in enumerate(texts)], benchmark=list(enumerate(items)))
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_decontamination"](spark, path).collect()}
    assert got == want and {i for _, i in want} >= {12, 13, 15, 16, 19}
    kept = {r["doc_id"] for r in decontamination.uncontaminated(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()}
    # "gamma" and "alpha beta" alone drop nothing
    assert kept == set(range(len(texts))) - {d for d, i in want if i not in (12, 13)}


def test_maximal_segments_of_many_places():
    """Falling sums and rising ones, a million places: linear, where walking back from each would be quadratic."""
    n = 1_000_000
    for places, scores in [(np.arange(n) * 3, np.full(n, 0.7)), (np.arange(n) * 2, np.random.default_rng(1).choice([0.3, 0.9], n)), (np.arange(n), np.full(n, 0.1))]:
        begun = time.process_time()
        found = toxicity.maximal_segments(places, scores, 0.5)
        assert time.process_time() - begun < 15
        assert found[0][0] == 0 and all(a[1] <= b[0] for a, b in zip(found, found[1:])) and all(s > 0 for _, _, s in found)


def test_maximal_segments_against_definition():
    rng = np.random.default_rng(7)

    def slow(scores):
        """Ruzzo and Tompa by definition: the best segment, then the same on both sides."""
        if not len(scores) or max(scores) <= 0:
            return []
        sums = np.concatenate([[0], np.cumsum(scores)])
        best = max(((sums[b] - sums[a], -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
        a, b = best[3], best[4]
        return slow(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in slow(scores[b:])]

    for _ in range(200):
        n = int(rng.integers(1, 25))
        places = np.flatnonzero(rng.random(n) < 0.35)
        scores = np.full(n, -0.53)
        scores[places] = rng.random(len(places)) * 2.1 + 0.01
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(places, scores[places], 0.53)]
        assert got == slow(scores)


def test_decay_solves_its_equation():
    scores, shares = np.array([2.0, 5.0]), np.array([0.01, 0.001])
    x = toxicity.decay_of(scores, shares, 0.5)
    assert (shares * np.exp(x * scores)).sum() + (1 - shares.sum()) * np.exp(-0.5 * x) == pytest.approx(1, abs=1e-6)


def test_one_label_only(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(30)], "doc_id long, text string")
    for value, score in ((0, 0.0), (1, 1.0)):
        labels = spark.createDataFrame([(i, value) for i in range(30)], "doc_id long, toxic int")
        found = toxicity.find_toxic(docs, toxicity.learn_from(docs, labels)).collect()
        assert {r["score"] for r in found} == {score}


# resampling


def test_gumbel_draws_follow_the_weights(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'good words here' else 'bad stuff there' end as text")
    target = resampling.place_counts(docs.where("doc_id % 2 = 0"))
    ratios = resampling.log_ratios(target, resampling.place_counts(docs))
    drawn = resampling.resample(docs, ratios, 0.25).collect()
    assert len(drawn) == 1000 and sorted(r["rank"] for r in drawn) == list(range(1, 1001))
    assert sum(r["doc_id"] % 2 == 0 for r in drawn) > 900
    flat = resampling.resample(docs, np.zeros(len(ratios)), 0.25).collect()
    assert 400 < sum(r["doc_id"] % 2 == 0 for r in flat) < 600


# personal data


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(8)
    model = tagger.Tagger.fresh(6, 5, units=3)
    model.weights = {k: v.astype(np.float64) + (rng.normal(0, 0.1, v.shape) if k == "moves" else 0) for k, v in model.weights.items()}
    x, y = rng.integers(0, 6, (4, 7)), rng.integers(0, 5, (4, 7))
    _, grads = model.gradients(x, y)
    for name, grad in grads.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, s)) for s in grad.shape)
            kept = model.weights[name][at]
            losses = []
            for step in (1e-5, -1e-5):
                model.weights[name][at] = kept + step
                losses.append(model.gradients(x, y)[0])
            model.weights[name][at] = kept
            assert grad[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-5)


def test_viterbi_finds_the_best_path():
    import itertools

    rng = np.random.default_rng(9)
    scores, moves = rng.normal(size=(3, 5, 4)), rng.normal(size=(4, 4))
    lengths = np.array([5, 3, 1])
    for whole, n, tags in zip(scores, lengths, tagger.viterbi(scores, moves, lengths)):
        assert tags[:n].tolist() == tagger.viterbi(whole[None, :n], moves)[0].tolist() and not tags[n:].any()
    for row, tags in zip(scores, tagger.viterbi(scores, moves)):
        value = lambda p: sum(row[t, k] for t, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))
        assert value(tags.tolist()) == pytest.approx(max(map(value, itertools.product(range(4), repeat=5))))


def test_tagger_finds_disguised_data(spark):
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 8))))
    rows = []
    for i in range(300):
        mail = f"{word()}.{rng.integers(99)}@{word()}.example.com"
        rows.append((i, " ".join([*[word() for _ in range(20)], mail, *[word() for _ in range(20)], str(rng.integers(10**9))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = personal.fit(docs)
    hidden = [(0, "please write to someone.77[at]place.example.com about the matter of today"), (1, "nothing here but 123 numbers @ home")]
    got = {r["doc_id"]: r for r in personal.find_personal(spark.createDataFrame(hidden, "doc_id long, text string"), model).collect()}
    kind, start, end = got[0]["spans"].split(":")
    assert kind == "email" and hidden[0][1][int(start) : int(end)] == "someone.77[at]place.example.com"
    assert got[0]["n_email"] == 0 and got[1]["spans"] == ""


def test_tagger_windows_cover_long_texts(spark):
    model = tagger.Tagger.fresh(personal.N_CLASSES, personal.N_TAGS)
    # a tagger that calls every sign but blanks part of an email
    blank = personal.classes_of(" ")[0]
    model.all_scores = lambda x: np.eye(personal.N_TAGS, dtype=np.float32)[np.where((x > 0) & (x != blank), 2, 0)] * 9
    model.weights["moves"][:] = 0
    text = "q" * 500 + "@" + "q" * 500
    assert personal.added_spans([text], model, [[]])[0] == []
    found = "qq" * 10 + " [AT] ".replace(" ", "") + "aa.bb" + "q" * 20
    assert len(found) <= personal.LONGEST
    for before in (0, 1, 31, 32, 63, 64, 1000, 5000):
        text = "z " * before + found + " z" * 3000
        assert personal.added_spans([text], model, [[]])[0] == [(0, 2 * before, 2 * before + len(found))]
    # a region of many parts
    text = " ".join(["1"] * 3000 + [found] + ["2"] * 3000)
    assert personal.added_spans([text], model, [[]])[0] == [(0, 6000, 6000 + len(found))]


def test_plausible_spans_hold_an_anchor():
    rng = np.random.default_rng(6)
    parts = ["[", "(", "AT", "at", "aT", "]", ")", " ", "dot", "aa", "bb", "1", "12", "255", ".", "+", "@", "\u0130", "-", "\u0661"]
    seen = 0
    for _ in range(20_000):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), int(rng.integers(1, 12))))
        for kind in range(4):
            if personal.plausible(kind, text):
                seen += 1
                begin, end = personal.regions("z" * 300 + text + "z" * 300)[0]
                assert re.search(personal.ANCHOR, text) and begin <= 300 and end >= 300 + len(text)
    assert seen > 100


def test_tagger_on_held_out_disguised_data(spark):
    """Disguised spans of documents that it was not trained on: nearly all are found, and next to nothing else is."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    held = common.held_out("doc_id")
    model = personal.fit(docs.where(~held))
    rng = np.random.default_rng(5)
    found = wanted = extra = 0
    for row in docs.where(held).orderBy("doc_id").limit(1500).collect():
        text, spans, at, out, true = row["text"] or "", [], 0, "", []
        for kind, start, end in sorted(personal.base_spans(text), key=lambda s: s[1]):
            if start >= at:
                out += text[at:start]
                other = personal.disguised(kind, text[start:end], rng)
                true.append((kind, len(out), len(out) + len(other)))
                out, at = out + other, end
        out += text[at:]
        base = personal.base_spans(out)
        added = personal.added_spans([out], model, [base])[0]
        for kind, start, end in true:
            if (kind, start, end) not in base:
                wanted += 1
                found += any(k == kind and a < end and start < b for k, a, b in [*base, *added])
        extra += sum(not any(a < t[2] and t[1] < b for t in true) for _, a, b in added)
    assert wanted > 80 and found >= 0.9 * wanted and extra <= 0.1 * found


def test_spans_and_tags_are_inverse():
    spans = [(0, 2, 6), (0, 6, 9), (3, 12, 13)]
    assert personal.spans_of(personal.tags_of(spans, 15)) == spans
