"""The trie against its oracle, and against a plain walk over rebuilt conversations."""

import hashlib
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from garbline.llm import prefix_trie as trie
from garbline.llm import registry
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def write(target, rows, clashing=()):
    """rows: (conv_id, turn, role, text)."""
    names = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(names)] + [pa.array(["x"] * len(rows)) for _ in clashing]
    pq.write_table(pa.table(columns, names=[n for n, _ in names] + list(clashing)), f"{target}/conversations.parquet")
    return str(target)


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members, ends = {}, {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(tuple(built[c][:d]), []).append(c)
        ends.setdefault(tuple(built[c]), []).append(c)
    out = {}
    for node, who in members.items():
        inner = [n for n in members if n[: len(node)] == node]
        children = {n for n in inner if len(n) == len(node) + 1}
        leaves = sum(1 for n in inner if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in inner))
        saved = sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in inner if n)
        ids = hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()
        out[who[0], len(node)] = (members[node[:-1]][0] if node else None, len(who), len(children), leaves, saved, ids)
    return out


def got(df):
    rows = df.collect()
    found = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(found) == len(rows)
    return found


ODD = [
    (0, 2, "user", "c d"), (0, None, "user", "a b"), (0, 1, None, None),
    (1, 0, "user", "a b"), (1, 1, "", ""), (1, 2, "user", "c d"), (1, 3, "user", "c d"), (1, 3, "user", "c d"),
    (2, 0, "user", None), (3, 5, "user", "word " * 30_000), (3, 6, "a", "tie two"), (3, 6, "a", "tie one"), (3, 6, "a", "tie one"),
    (21, 0, "user", "x"), (21, 1, "user", "y"), (22, 0, "user", "x"), (23, 0, None, "z"), (24, None, None, None), (24, None, None, None),
    (None, 0, "user", "lost"), (None, None, None, None), (59, 0, "us", "er:a"), (58, 0, "user", ":a"), (57, 0, "user", ":a"),
]
ODD += [(k, t, "user", f"t{t}") for k in range(40, 60) for t in range(k % 7)]
ODD += [(100, t, "user", f"long {t % 3}") for t in range(300)] + [(103, t, "user", f"long {t % 3}") for t in range(250)]


@pytest.mark.parametrize("kind", ["odd", "empty", "copies"])
def test_against_brute_force(spark, tmp_path, kind):
    rows = {"odd": ODD, "empty": [], "copies": [(c, t, "user", f"turn {t}") for c in range(1500) for t in range(3)]}[kind]
    path = write(tmp_path, rows, ["depth", "rep", "pos", "words", "f0", "n_convs"])
    assert got(registry.queries()["op11_prefix_trie"](spark, path)) == brute(rows)


def test_oracle(spark, small_dir):
    same, note = compare(spark, connect(small_dir), "op11", trie.op11_prefix_trie, trie.ORACLE, small_dir)
    assert same, note


def test_colliding_products_are_found_and_repaired(spark, monkeypatch):
    """If different prefixes have equal products, verification fails and asks for other bases."""
    asked, real, products = [], trie.verified_nodes, trie.products

    def watched(paths):
        nodes, sound = real(paths)
        asked.append(sound)
        return nodes, sound

    def colliding(turns, turn_of):
        zero = trie.F.lit(0).cast("bigint")
        out = products(turns, turn_of)
        return out.withColumns({c: zero for c in out.columns if c[0] in "bp" and c[1:].isdigit()}) if turn_of == 0 else out

    monkeypatch.setattr(trie, "verified_nodes", watched)
    monkeypatch.setattr(trie, "products", colliding)
    rows = [(c, t, "user", f"{(c * (t + 1)) // 20 % 7}") for c in range(0, 140, 20) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(trie.prefix_trie(df)) == brute(rows)
    assert asked == [False, True]


def test_a_product_of_products_is_the_product(spark):
    """Powers against Python's own."""
    prime, base = trie.PRIMES[0], trie.BASES[0]
    rows = spark.range(1, 2000, 37).select("id", trie.powers(trie.F.col("id"), base, prime).alias("p")).collect()
    assert all(r["p"] == pow(base, r["id"], prime) for r in rows)
