"""Secret scans by multipart credential linking, with DataFrame functions only.

Three kinds of secrets stand on their own (``BASE``). Access identifiers, secrets and
endpoints that prove nothing alone (``PARTS``) are weak candidates. Every part is an
interval of its text; weak ones are interval-joined to the parts of a complementary role
within ``scope`` characters and are reported only where one is found.

The join never pairs parts with parts. A candidate has a partner exactly if, of the parts of a
complementary role that start no later than ``scope`` behind its end, one ends no earlier
than ``scope`` before its start. So each text's parts, by start, and candidates, by end, are
walked once with the largest end so far of each role, whatever their lengths and number.

NULL and empty texts have no spans. Rows that repeat are scanned and returned each on its
own; a NULL id is kept. Whole texts are scanned; positions are code points, the end excluded. Spans that begin
together go by kind as listed. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garbline.llm.common import table
from garbline.llm.registry import query
from garbline.session import cut_lineage

# Fixed patterns of the base kinds. The second is the number of the group that holds the
# value, the third the least length of that value.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    # shorter runs would fail anyway, and a run cannot begin inside another
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
# Weak candidates: (pattern, role). Without a partner they are not reported.
PARTS = {
    "login": (r"(?i:(?:user|username|login|client_?id|account|access_?id))\x20*[:=]\x20*[A-Za-z0-9_.@-]{3,}", "id"),
    "keyid": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{12,32}(?![A-Za-z0-9+/_=-])", "id"),
    "value": (r"(?i:(?:password|passwd|secret|token|api_?key|pwd))\x20*[:=]\x20*[^\x20\x09-\x0D\"',;]{4,}", "secret"),
    "blob": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Z0-9+/_=-]*[a-z])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", "secret"),
    "endpoint": (r"(?i:(?:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3))://[^\x20\x09-\x0D\"'<>]+", "endpoint"),
}
BASE_ROLES = {"assign": "secret", "access": "id", "hex": "secret"}
ROLES = BASE_ROLES | {kind: role for kind, (_, role) in PARTS.items()}
# What has to be near for a weak candidate of each role to be reported.
PARTNERS = {"id": ["secret"], "secret": ["id", "endpoint"], "endpoint": ["secret"]}
KINDS = [*BASE, *PARTS]
SCOPE = 200


def find_all(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end) in code points.

    The text is cut into pairs of a gap and a match; the last gap ends at the end of the
    text, so each character is looked at once. Lengths add up to positions.
    """
    whole = rf"(?s)(.*?)({pattern}|\z)"
    gaps = F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(1)), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(2)), F.length)
    value = sizes if group == 0 else F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(group + 2)), F.length)
    pairs = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), value.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    walk = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(
                (x["size"] > 0) & (x["value"] >= least),
                F.concat(
                    acc["found"],
                    F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end"))),
                ),
            )
            .otherwise(acc["found"])
            .alias("found"),
        ),
    )
    return F.when(text.rlike(pattern), walk["found"]).otherwise(none)


def _tagged(kind: str, spans: Column) -> Column:
    rank = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` in the given order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: ``row`` (a number of its own), ``id``, and the sorted arrays
    ``base`` and ``weak`` of (start, rank of the kind, end). No shuffle.

    A weak candidate within a base span, or over one of its own role, is that span seen again and is
    left out. One that merely holds or cuts a base span of another role stays.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    found = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("_text")).select(
        "id",
        F.array_sort(F.concat(*[_tagged(k, find_all(text, p, g, n)) for k, (p, g, n) in BASE.items()])).alias("base"),
        F.concat(*[_tagged(k, find_all(text, p)) for k, (p, _) in PARTS.items()]).alias("_weak"),
    )
    roles = F.array(*[F.lit(ROLES[k]) for k in KINDS])
    over = lambda b, w: (b["start"] < w["end"]) & (w["start"] < b["end"])
    again = lambda b, w: ((b["start"] <= w["start"]) & (w["end"] <= b["end"])) | (roles[b["rank"]] == roles[w["rank"]])
    apart = lambda w: ~F.exists("base", lambda b: over(b, w) & again(b, w))
    return found.select(
        F.monotonically_increasing_id().alias("row"), "id", "base", F.array_sort(F.filter("_weak", apart)).alias("weak")
    )


def link(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``row`` and ``linked``: the weak candidates with a complementary part within ``scope`` characters."""
    roles = F.array(*[F.lit(ROLES[k]) for k in KINDS])
    parts = scanned.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("s"))
    here = F.struct(F.col("s.start").alias("at"), F.lit(False).alias("probe"))
    there = F.struct((F.col("s.end") + scope).alias("at"), F.lit(True).alias("probe"))
    points = F.when(F.col("s")["rank"] >= len(BASE), F.array(here, there)).otherwise(F.array(here))
    events = parts.select("row", "s", roles[F.col("s")["rank"]].alias("role"), F.explode(points).alias("point"))
    # a part that starts where a candidate's scope ends comes first
    before = Window.partitionBy("row").orderBy("point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = {role: F.max(F.when((F.col("role") == role) & ~F.col("point.probe"), F.col("s.end"))).over(before) for role in PARTNERS}
    walked = events.select("*", *[end.alias(f"last_{role}") for role, end in reach.items()])
    ends = F.create_map(*[x for r, p in PARTNERS.items() for x in (F.lit(r), F.array(*[F.col(f"last_{q}") for q in p]))])
    near = F.exists(ends[F.col("role")], lambda end: F.coalesce(end + scope >= F.col("s.start"), F.lit(False)))
    return walked.where(F.col("point.probe") & near).groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("linked"))


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """``id``, ``base`` and ``linked`` spans, one row for each row of ``docs``."""
    scanned = cut_lineage(scan(docs, id_column, text_column), "secrets")
    linked = link(scanned, scope)
    return scanned.join(linked, "row", "left").select(
        "id", "base", F.coalesce("linked", F.array().cast(scanned.schema["weak"].dataType)).alias("linked")
    )


@query("op10_secrets")
def op10_secrets(spark, sf_dir) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("bigint")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spelled(F.array_sort(F.concat("base", "linked"))).alias("spans"),
        F.size("linked").cast("bigint").alias("n_linked"),
    )
