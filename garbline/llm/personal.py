"""Personal data: fixed patterns, and a character tagger that finds what they miss.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its check.
A bidirectional LSTM with CRF transitions (``tagger``) is trained on windows of a bounded sample
of documents, labelled with their base spans, some of them disguised (other separators,
spelled-out signs). It reads texts in windows of ``WINDOW`` characters, half of them shared with the next. The
scores that overlapping windows give a character are averaged, and one path is sought through each
region of a text, so that its tags are those of a single decoding. A found span is reported if it
overlaps no base span and is plausible for its kind, for which it must hold an ``@``, a digit or a
bracketed "at" (an anchor) and be no longer than ``LONGEST``. Regions are all characters within ``LONGEST`` of an
anchor, so every span that could be reported lies in one as a whole; the rest of a text is not decoded.

NULL text counts as empty. Rows that repeat are searched each and give equal rows. Without
a base span in the sample nothing is learned, and only base spans are reported. Positions
are code points, the end excluded. Texts are searched whole; a region of more than ``PART`` characters is decoded
in parts that overlap by four times the longest span. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.llm.common import score_texts, slices, table
from garbline.llm.registry import query
from garbline.llm.tagger import Tagger, viterbi

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000  # documents that the tagger is trained on
PER_DOCUMENT = 6  # windows of a sampled document
WINDOW = 64
STEP = WINDOW // 2
LONGEST = 64  # characters of a span that the tagger adds
PART = 4096  # characters decoded as one sequence
AT_ONCE = 1 << 16  # characters decoded together

# Fixed patterns of the base kinds.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a run of digits cannot match from its middle if it did not from its start
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Every span that ``plausible`` accepts holds one of these.
ANCHOR = r"[0-9@]|[\[(] ?[aA][tT]"
_ANCHOR = re.compile(ANCHOR)
_EMAIL_START = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(] ?[aA][tT])")
_NOT_DIGITS = re.compile(r"[^0-9]+")

# Character classes: 0 is padding, 1 anything that is not listed.
_SIGNS = "abcdefghijklmnopqrstuvwxyz@.-+()_%:/=,[]{}\"' "
_CLASSES = {sign: i + 4 for i, sign in enumerate(_SIGNS)} | {"\n": 3, "\t": 3, "\r": 3}
_UPPER, _DIGIT = 2, len(_SIGNS) + 4
N_CLASSES = _DIGIT + 1
N_TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind


def class_table() -> np.ndarray:
    out = np.ones(129, np.uint8)
    for sign, number in _CLASSES.items():
        out[ord(sign)] = number
    out[ord("A") : ord("Z") + 1] = _UPPER
    out[ord("0") : ord("9") + 1] = _DIGIT
    return out


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return class_table()[np.minimum(points, 128)]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The matches of local part and domain, looked for from each sign between them."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        match = _DOMAIN.match(text, at) if begin < at else None
        if match:
            out.append((begin, match.end()))
            done = match.end()
        else:
            # what stands before this sign cannot belong to a later match
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return out


def _card_ok(found: str) -> bool:
    digits = _NOT_DIGITS.sub("", found)
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    out += [(2, *m.span()) for m in _CARD.finditer(text) if _card_ok(m.group())]
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15]
    return out


def plausible(kind: int, found: str) -> bool:
    """Whether what the tagger found can be of its kind."""
    if len(found) > LONGEST:
        return False
    digits = _NOT_DIGITS.sub("", found)
    low = found.lower()
    if kind == 0:
        sign = re.search(r"@|[\[(] ?at ?[\])]", low)
        return bool(sign) and sign.start() > 0 and len(re.findall(r"[a-z0-9]{2,}", low[sign.end() :])) >= 2
    if kind == 1:
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[A-Za-z]", found.replace("dot", ""))
    if kind == 2:
        return _card_ok(found) and len(digits) * 2 >= len(found)
    return 9 <= len(digits) <= 15 and len(digits) * 2 >= len(found) and found[0] in "+(0123456789" and not re.search(r"[A-Za-z]", found)


def tags_of(spans: list[tuple[int, int, int]], length: int) -> np.ndarray:
    out = np.zeros(length, np.int8)
    for kind, start, end in reversed(spans):
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the runs of equal kinds; a first character begins a new run."""
    at = np.flatnonzero(tags)
    if not len(at):
        return []
    kinds = (tags[at] - 1) // 2
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(kinds) != 0) | (tags[at][1:] % 2 == 1)) + 1
    return [(int(k[0]), int(p[0]), int(p[-1]) + 1) for k, p in zip(np.split(kinds, cuts), np.split(at, cuts))]


def disguised(kind: int, found: str, rng) -> str:
    """Another way to write personal data of the same kind."""
    found = "".join(str(rng.integers(10)) if c.isdigit() else c for c in found) if kind in (2, 3) else found
    if kind == 0:
        local, domain = found.split("@", 1)
        sign = rng.choice(["@", " @ ", "[at]", "(at)", " [at] ", " (at) "])
        dot = rng.choice([".", ".", " . ", "[.]", "[dot]", "(dot)", " dot "])
        return local + sign + domain.replace(".", dot)
    if kind == 1:
        return found.replace(".", rng.choice([".", "[.]", " . ", "(.)", " dot "]))
    digits = _NOT_DIGITS.sub("", found)
    sign = rng.choice([" ", "-", ".", "/", "_", " - "])
    if kind == 2:
        digits = digits[:-1] + next(d for d in "0123456789" if luhn(digits[:-1] + d))
        return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    start = rng.choice(["", "00", "+", "(+", "0"])
    body = sign.join([digits[:2], *[digits[i : i + 3] for i in range(2, len(digits), 3)]])
    return start + (body.replace(sign, ")" + sign, 1) if start == "(+" else body)


def training_windows(docs: DataFrame, text: str, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and their tags from ``docs``, which must be few (``SAMPLE``).

    For each base span one window as it is and one disguised, at a random place in the window; for
    anchors outside spans a window as it is. At most ``PER_DOCUMENT`` of each from a document.
    """

    def run(batches):
        for piece in slices(batches, "text"):
            xs, ys = [], []
            for row in piece.column(0).to_pylist():
                if not row or not _ANCHOR.search(row):
                    continue
                rng = np.random.default_rng([seed, len(row)])
                spans = sorted(base_spans(row), key=lambda s: (s[1], s[0]))
                tags = tags_of(spans, len(row))

                def add(body: str, marks: np.ndarray, around: int) -> None:
                    begin = max(0, around - int(rng.integers(WINDOW // 8, WINDOW)))
                    x, y = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int8)
                    some = classes_of(body[begin : begin + WINDOW])
                    x[: len(some)], y[: len(some)] = some, marks[begin : begin + WINDOW]
                    xs.append(x.tobytes())
                    ys.append(y.tobytes())

                for kind, start, end in spans[:PER_DOCUMENT]:
                    middle = (start + end) // 2
                    add(row, tags, middle)
                    other = disguised(kind, row[start:end], rng)
                    left, right = max(0, start - WINDOW), min(len(row), end + WINDOW)
                    marks = np.concatenate([tags[left:start], tags_of([(kind, 0, len(other))], len(other)), tags[end:right]])
                    add(row[left:start] + other + row[end:right], marks, start - left + len(other) // 2)
                outside = [m.start() for m in _ANCHOR.finditer(row) if not tags[m.start()]]
                for at in outside[:: max(1, len(outside) // PER_DOCUMENT)][:PER_DOCUMENT]:
                    add(row, tags, at)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["x", "y"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "x binary, y binary").toPandas().sort_values(["x", "y"])
    read = lambda c, kind: np.frombuffer(b"".join(rows[c]), kind).reshape(-1, WINDOW)
    return read("x", np.uint8), read("y", np.int8)


def fit(docs: DataFrame, id_column: str = "doc_id", text: str = "text", most: int = SAMPLE, steps: int = 300) -> Tagger | None:
    """Train on about ``most`` documents, chosen by a hash of their ids; None if they hold no base span."""
    share = int(1_000_000 * min(1.0, most / max(1, docs.count())))
    sample = docs.where(F.pmod(F.xxhash64(id_column, F.lit("personal")), F.lit(1_000_000)) < share)
    x, y = training_windows(sample, text)
    marked = y.any(1)
    if not marked.any():
        return None
    # as many windows with spans as without
    order = np.concatenate([np.resize(np.flatnonzero(marked), len(y)), np.resize(np.flatnonzero(~marked), len(y) if (~marked).any() else 0)])
    model = Tagger.fresh(N_CLASSES, N_TAGS)
    model.train(x[order], y[order].astype(np.int64), steps)
    return model


def regions(text: str) -> list[tuple[int, int]]:
    """The parts of a text in which a span may lie that ``plausible`` accepts: all within ``LONGEST`` of an anchor.

    An accepted span holds an anchor and has at most ``LONGEST`` characters. Very long parts are cut into
    pieces of ``PART`` that overlap by twice as much as a span may take.
    """
    out: list[tuple[int, int]] = []
    for m in _ANCHOR.finditer(text):
        begin, end = max(0, m.start() - LONGEST), min(len(text), m.end() + LONGEST)
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    cut = []
    for begin, end in out:
        while end - begin > PART:
            cut.append((begin, begin + PART))
            begin += PART - 4 * LONGEST
        cut.append((begin, end))
    return cut


def tagged(texts: list[str], model: Tagger) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each text its regions with the best tags of their characters.

    Windows overlap, so most characters have the scores of two. These are averaged, and one path is
    sought through the whole region: no window decides alone, and no span is pasted from several paths.
    """
    parts = [(i, begin, end) for i, text in enumerate(texts) for begin, end in regions(text)]
    parts.sort(key=lambda p: p[1] - p[2])
    coded = [classes_of(text) for text in texts]
    out: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in texts]
    at = 0
    while at < len(parts):
        longest = parts[at][2] - parts[at][1]
        some = parts[at : at + max(1, AT_ONCE // longest)]
        at += len(some)
        grids = [np.arange(max(0, begin // STEP - 1), (end - 1) // STEP + 1) for _, begin, end in some]
        x = np.zeros((sum(map(len, grids)), WINDOW), np.uint8)
        row = 0
        for (i, _, _), grid in zip(some, grids):
            for k in grid.tolist():
                signs = coded[i][k * STEP : k * STEP + WINDOW]
                x[row, : len(signs)] = signs
                row += 1
        told, row = model.all_scores(x), 0
        sums = np.zeros((len(some), longest, told.shape[2]), np.float32)
        for lane, ((_, begin, end), grid) in enumerate(zip(some, grids)):
            seen = np.zeros(end - begin, np.float32)
            for k in grid.tolist():
                low, high = max(begin, k * STEP), min(end, k * STEP + WINDOW)
                sums[lane, low - begin : high - begin] += told[row, low - k * STEP : high - k * STEP]
                seen[low - begin : high - begin] += 1
                row += 1
            sums[lane, : end - begin] /= seen[:, None]
        lengths = np.array([end - begin for _, begin, end in some])
        for (i, begin, end), tags in zip(some, viterbi(sums, model.weights["moves"], lengths)):
            out[i].append((begin, end, tags[: end - begin]))
    return out


def added_spans(texts: list[str], model: Tagger, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """For each text, the plausible spans of the tagger that overlap no base span."""
    out = []
    for text, found, known in zip(texts, tagged(texts, model), base):
        more: set[tuple[int, int, int]] = set()
        for begin, _, tags in sorted(found, key=lambda f: f[0]):
            for kind, start, end in spans_of(tags):
                start, end = start + begin, end + begin
                # a local part has no blanks: words before it are not part of the address
                begun = _EMAIL_START.search(text, start, end) if kind == 0 else None
                start = begun.start() if begun else start
                while start < end and text[start] in " \n\t\r,.;:-":
                    start += 1
                while start < end and text[end - 1] in " \n\t\r,.;:-([{":
                    end -= 1
                taken = any(a < end and start < b for _, a, b in [*known, *more])
                if start < end and not taken and plausible(kind, text[start:end]):
                    more.add((kind, start, end))
        out.append(sorted(more))
    return out


def spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal(docs: DataFrame, model: Tagger | None, text: str = "text") -> DataFrame:
    """``docs`` with the number of base spans of each kind, ``base_sha256``, ``spans`` and ``n_added``."""

    def score(texts: pa.Array):
        n = len(texts)
        base: list = [[] for _ in range(n)]
        more: list = [[] for _ in range(n)]
        held = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, ANCHOR), False).to_numpy(zero_copy_only=False))
        some = [texts[int(i)].as_py() for i in held]
        for i, body in zip(held, some):
            base[i] = base_spans(body)
        if model is not None:
            for i, found in zip(held, added_spans(some, model, [base[i] for i in held])):
                more[i] = found
        counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in range(len(KINDS))]
        hashes = pa.array([hashlib.sha256(spelled(spans).encode()).hexdigest() for spans in base])
        return (*counts, hashes, pa.array([spelled(a + b) for a, b in zip(base, more)]), pa.array([len(m) for m in more], pa.int64()))

    columns = [f"n_{kind} long" for kind in KINDS] + ["base_sha256 string", "spans string", "n_added long"]
    return score_texts(docs, text, ", ".join(columns), score, 1 << 20)


@query("op5_personal")
def op5_personal(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = find_personal(docs, fit(docs))
    return found.select("doc_id", *[f"n_{kind}" for kind in KINDS], "base_sha256", "spans", "n_added")
