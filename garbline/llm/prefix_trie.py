"""Prefix trie of conversations that are rebuilt from a base's head and their own suffix.

No rebuilt conversation is materialised. Every turn is stored once, as a digest of role and
text, and stands for an element (length, value) of a monoid: the product of two elements
adds the lengths, and the second value, shifted by the first length, to the first,

    (m, u) * (n, v) = (m + n, u + B**m * v)   modulo a prime, for three primes.

One pass of running products over the stored turns gives the product of every own prefix. The
product of a rebuilt prefix is then the base's head times the quotient of two own prefixes, a
few multiplications for each turn. Prefixes of equal depth and product form a node. A
node is verified by reference: all its members must refer to stored turns of one digest
(SHA-256) and have one parent, so that by induction over the depth equal products are equal
sequences. If ever a node fails, all is done again with other bases.

A node is named by its smallest member and its depth. A conversation is the smallest member
from some depth on, a chain of nodes, so what a subtree holds is the sum, over the members, of their
chains: two aggregations over the rows (conversation, depth) answer for all depths, without a
round for each level. Hashes of the member lists are taken over sorted pieces of at most 1,024
ids, streamed in order, so no list is ever held whole.

Rows without a conversation id are left out; NULL roles and texts are empty. Turns are ordered by
number, NULL first, equal numbers by role, then the text's first 64 characters, then its digest; equal
rows are turns of their own. A head is cut to what the base has, and missing bases give none.
Long texts are hashed where they are read and never shuffled; long conversations are numbered
by a global sort and summed in pieces, so none meets in one task. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garbline.functions.spread import join_reduced, number_rows, sum_before
from garbline.llm.common import WORD, table
from garbline.llm.registry import query
from garbline.session import cut_lineage, discard_since, scratch_mark

PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 742938285, 950706376)
PLACES = 34  # binary digits of a turn's place
GROUP = 20  # a conversation's base is the first id of its group of so many
HEADS = 4  # heads have 0 .. HEADS - 1 turns
PIECE = 10  # ids of a list that differ in the last so many bits form a piece
PRINT = [f"f{k}" for k in range(len(PRIMES))]
PARENT = [f"g{k}" for k in range(len(PRIMES))]


def base_of(k: int, turn_of: int) -> int:
    """The base of the ``k``-th product in one attempt, between 2 and the prime."""
    return 2 + (BASES[k] + turn_of) % (PRIMES[k] - 2)


def powers(place: Column, base: int, prime: int) -> Column:
    """``base ** place`` modulo ``prime``, by the binary digits of ``place``."""
    out, factor = F.lit(1).cast("bigint"), base % prime
    for digit in range(PLACES):
        out = F.pmod(out * F.when(place.bitwiseAND(1 << digit) != 0, F.lit(factor).cast("bigint")).otherwise(F.lit(1).cast("bigint")), F.lit(prime))
        factor = factor * factor % prime
    return out


def stored_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``digest``, ``words`` of every turn, in two written tables."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        F.substring(text, 1, 64).alias("head"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("head").asc(), F.col("digest").asc()]
    numbered = number_rows(cut_lineage(told, "turns"), order, "row", 0).select("conv_id", "row", "digest", "words")
    firsts = numbered.groupBy("conv_id").agg(F.min("row").alias("first"))
    return cut_lineage(
        join_reduced(numbered, firsts, ["conv_id"], "inner").select("conv_id", (F.col("row") - F.col("first") + 1).alias("pos"), "digest", "words"), "turns"
    )


def products(turns: DataFrame, turn_of: int) -> DataFrame:
    """``turns`` with ``b0 ..`` and ``p0 ..``: the products of the own prefix before and up to each turn."""
    terms = {}
    for k, prime in enumerate(PRIMES):
        value = F.pmod(F.xxhash64("digest", F.lit(turn_of * len(PRIMES) + k)), F.lit(prime))
        terms[f"t{k}"] = F.pmod(value * powers(F.col("pos"), base_of(k, turn_of), prime), F.lit(prime))
    summed = sum_before(cut_lineage(turns.withColumns(terms), "terms"), "conv_id", "pos", {f"b{k}": F.col(f"t{k}") for k in range(len(PRIMES))})
    both = {f"b{k}": F.pmod(f"b{k}", F.lit(p)) for k, p in enumerate(PRIMES)} | {f"p{k}": F.pmod(F.col(f"b{k}") + F.col(f"t{k}"), F.lit(p)) for k, p in enumerate(PRIMES)}
    return cut_lineage(summed.withColumns(both).drop(*terms), "products")


def rebuilt(prefixes: DataFrame, turn_of: int) -> DataFrame:
    """One row for each conversation and depth: ``conv_id``, ``depth``, ``f*``, the parent's ``g*``, ``digest``, ``words``, ``is_end``."""
    own = [f"p{k}" for k in range(len(PRIMES))]
    early = F.when(F.col("pos") < HEADS, F.struct("pos", "digest", "words", *own))
    convs = cut_lineage(prefixes.groupBy("conv_id").agg(F.count("*").alias("n_own"), F.sort_array(F.collect_list(early)).alias("head")), "convs")
    wanted = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    plan = wanted.join(convs.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head")), "base", "left")
    taken = F.when(F.col("h") > 0, F.slice(F.coalesce("base_head", F.slice("head", 1, 0)), 1, F.greatest("h", F.lit(1)))).otherwise(F.slice("head", 1, 0))
    plan = plan.withColumn("taken", taken).withColumn("n_taken", F.size("taken"))
    plan = plan.withColumn("length", F.col("n_taken") + F.greatest(F.lit(0).cast("bigint"), F.col("n_own") - F.col("h")))
    at = lambda array, place, field: F.when(place > 0, F.get(array, place - 1).getField(field)).otherwise(F.lit(0).cast("bigint"))
    skipped = F.least(F.col("h").cast("bigint"), F.col("n_own")).cast("int")
    plan = cut_lineage(
        plan.select(
            "conv_id", "h", "n_taken", "length", "taken",
            *[at(F.col("taken"), F.col("n_taken"), f"p{k}").alias(f"head{k}") for k in range(len(PRIMES))],
            *[at(F.col("head"), skipped, f"p{k}").alias(f"skip{k}") for k in range(len(PRIMES))],
        ),
        "plan",
    )
    zero = F.lit(0).cast("bigint")
    top = F.struct(zero.alias("depth"), *[zero.alias(c) for c in PRINT + PARENT], F.unhex(F.lit("")).alias("digest"), zero.alias("words"))
    inner = F.transform(
        "taken",
        lambda x, i: F.struct(
            x["pos"].alias("depth"),
            *[x[f"p{k}"].alias(f"f{k}") for k in range(len(PRIMES))],
            *[F.when(i > 0, F.get("taken", i - 1).getField(f"p{k}")).otherwise(zero).alias(f"g{k}") for k in range(len(PRIMES))],
            x["digest"].alias("digest"),
            x["words"].alias("words"),
        ),
    )
    heads = plan.select("conv_id", "length", F.explode(F.concat(F.array(top), inner)).alias("x")).select("conv_id", "length", "x.*")

    def behind_head(k: int, product: str) -> Column:
        """Head times the own suffix: the own product without the turns that the head replaces, moved to its place."""
        prime, base = PRIMES[k], base_of(k, turn_of)
        move = F.lit(1).cast("bigint")
        for missing in range(1, HEADS):
            move = F.when(F.col("h") - F.col("n_taken") == missing, F.lit(pow(base, -missing, prime)).cast("bigint")).otherwise(move)
        return F.pmod(F.col(f"head{k}") + F.pmod(F.col(product) - F.col(f"skip{k}"), F.lit(prime)) * move, F.lit(prime))

    suffixes = prefixes.join(plan.drop("taken"), "conv_id").where("pos > h")
    suffixes = suffixes.select(
        "conv_id", "length", (F.col("pos") - F.col("h") + F.col("n_taken")).alias("depth"),
        *[behind_head(k, f"p{k}").alias(f"f{k}") for k in range(len(PRIMES))],
        *[behind_head(k, f"b{k}").alias(f"g{k}") for k in range(len(PRIMES))],
        "digest", "words",
    )
    return cut_lineage(heads.unionByName(suffixes).withColumn("is_end", F.col("depth") == F.col("length")).drop("length"), "paths")


def verified_nodes(paths: DataFrame) -> tuple[DataFrame, bool]:
    """``depth``, ``f*``, ``g*``, ``rep``, ``n_convs``, ``words`` of each node, and whether all members agree."""
    single = {c: (F.min(c), F.max(c)) for c in [*PARENT, "digest"]}
    nodes = paths.groupBy("depth", *PRINT).agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        *[low.alias(c) for c, (low, _) in single.items()], *[high.alias(f"{c}_high") for c, (_, high) in single.items()],
    )
    torn = F.lit(False)
    for c in single:
        torn = torn | (F.col(c) != F.col(f"{c}_high"))
    nodes = cut_lineage(nodes.withColumn("torn", torn).drop("digest", *[f"{c}_high" for c in single]), "nodes")
    return nodes.drop("torn"), not nodes.where("torn").head(1)


def list_hashes(paths: DataFrame) -> DataFrame:
    """``depth``, ``f*`` and ``ends_sha256`` of the nodes at which conversations end."""
    piece = F.shiftright("conv_id", PIECE).alias("piece")
    pieces = paths.where("is_end").groupBy("depth", *PRINT, piece).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    key = ["depth", *PRINT]

    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            columns = [batch.column(i).to_pylist() for i in range(len(key))]
            for node, ids in zip(zip(*columns), batch.column(len(key)).to_pylist()):
                if node == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = node, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield rows(done)
        if now is not None:
            yield rows([(*now, state.hexdigest())])

    def rows(done):
        columns = list(zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())], names=[*key, "ends_sha256"])

    ordered = pieces.repartition(*key).sortWithinPartitions(*key, "piece").select(*key, "ids")
    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in key) + ", ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256`` of every node."""
    mark = scratch_mark()
    spark, turns = conversations.sparkSession, stored_turns(conversations)
    sound, turn_of = False, 0
    while not sound:
        paths = rebuilt(products(turns, turn_of), turn_of)
        nodes, sound = verified_nodes(paths)
        turn_of += 1

    key = ["depth", *PRINT]
    as_parent = dict(zip(PARENT, PRINT))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(g).alias(f) for g, f in as_parent.items()]).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(f).alias(g) for g, f in as_parent.items()], F.col("rep").alias("parent_conv_id"))
    # Plain joins of written tables, which adaptive execution can split: one parent may have most nodes.
    linked = nodes.join(above, ["depth", *PARENT], "left").drop(*PARENT)
    linked = linked.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    linked = cut_lineage(linked.withColumn("weight", (F.col("n_convs") - 1) * F.col("words")).drop("words"), "linked")

    chains = linked.groupBy(F.col("rep").alias("conv_id")).agg(F.sum("weight").alias("weight"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    held = join_reduced(paths.select("conv_id", *key), chains, ["conv_id"], "left").groupBy(*key).agg(
        F.coalesce(F.sum("weight"), F.lit(0)).cast("bigint").alias("below"), F.coalesce(F.sum("leaf"), F.lit(0)).cast("bigint").alias("n_leaves")
    )
    before = sum_before(linked.select("rep", *key, "parent_conv_id", "n_convs", "n_children", "weight"), "rep", "depth", {"earlier": F.col("weight")})
    nothing = hashlib.sha256(b"").hexdigest()
    out = before.join(held, key).join(list_hashes(paths), key, "left").select(
        F.col("rep").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("below") - F.col("earlier")).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
    out = cut_lineage(out, "trie")
    discard_since(spark, mark)
    return out


# The same by definition: every prefix as a list, every node with all nodes that begin with it.
ORACLE = rf"""
WITH RECURSIVE bits AS (
  SELECT i AS slot, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT slot, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY slot) AS t FROM bits WHERE step = 8),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
parts AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
whole AS (
  SELECT c.conv_id, list(struct_pack(r := p.role, t := p.text) ORDER BY part, pos) FILTER (p.conv_id IS NOT NULL) AS path, count(p.conv_id) AS len
  FROM convs c LEFT JOIN parts p USING (conv_id) GROUP BY c.conv_id),
prefixes AS (
  SELECT conv_id, len, d AS depth, CASE WHEN d = 0 THEN [] ELSE path[1:d] END AS path FROM whole, LATERAL unnest(range(len + 1)) u(d)),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256,
         CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(path)[depth].t, '{WORD}')) END AS words
  FROM prefixes GROUP BY path, depth),
kin AS (
  SELECT n.conv_id, n.depth, n.n_convs, n.words, u.d AS up, CASE WHEN u.d = 0 THEN [] ELSE n.path[1:u.d] END AS above
  FROM nodes n, LATERAL unnest(range(n.depth + 1)) u(d)),
kinship AS (
  SELECT a.conv_id AS top, a.depth AS top_depth, k.conv_id, k.depth, k.n_convs, k.words
  FROM kin k JOIN nodes a ON a.depth = k.up AND a.path = k.above),
children AS (SELECT top AS conv_id, top_depth AS depth, count(*) AS n FROM kinship WHERE depth = top_depth + 1 GROUP BY 1, 2),
parents AS (SELECT conv_id, depth, top FROM kinship WHERE depth = top_depth + 1),
sums AS (
  SELECT k.top, k.top_depth, sum((k.n_convs - 1) * k.words)::BIGINT AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM kinship k LEFT JOIN children c USING (conv_id, depth) GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.top AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.top = n.conv_id AND s.top_depth = n.depth
LEFT JOIN parents p USING (conv_id, depth) LEFT JOIN children c USING (conv_id, depth)
"""


@query("op11_prefix_trie", ORACLE)
def op11_prefix_trie(spark, sf_dir) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
