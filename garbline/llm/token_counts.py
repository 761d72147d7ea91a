"""Token counts of every prefix of every text, by dynamic programming over prefixes.

A byte-pair encoding is right if and only if every two neighbouring tokens are: their bytes,
encoded alone, give the same two tokens. So the encoding of a prefix ends in the one token
that is a right neighbour of the last token of the shorter prefix before it, and one token and
one count kept for each prefix are all that is needed. The step runs inside the
pieces into which the vocabulary splits a text (words, numbers, marks, white space), once
for each distinct piece of a task; pieces that begin alike share their beginning. Counts of
whole prefixes are those of the pieces before plus that of the piece's own prefix.

A prefix of a text may be split into other pieces than the text is: white space at its end is
one piece, half a contraction is two, half a special string is plain text. These counts are
set apart, so the count at every code point is what the library gives for that prefix.

``prefix_counts`` stores the counts, as compressed differences, beside each row;
``within_budget`` answers from them how many tokens a text has, whether it exceeds a budget and how
many code points fit; ``tokens_upto`` and ``longest_within`` do so inside a task.

NULL texts count as empty and have no tokens. Rows that repeat, and rows without an id, stay.
Texts are handled whole; memory grows with the longest one (about 60 bytes for each code point).
An empty table gives an empty result; other columns of the input are not returned. Nothing is
shuffled. The vocabulary is read by the driver and travels with the job.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.llm.common import slices, table
from garbline.llm.registry import query

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CACHED = 400_000  # pieces whose counts a task remembers
SHORT = 40  # bytes of pieces that are counted together, the longer ones one by one
LETTER, NUMBER, OTHER, SPACE = range(4)
LAST_CODE_POINT = 0x10FFFF
# Fixed: endings that form a piece with the apostrophe before them.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


def byte_letters() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def character_classes(content: str) -> tuple[np.ndarray, np.ndarray]:
    """First code points and classes of the runs of equal class, as the vocabulary's own splitter sees them."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_str(content).pre_tokenizer.pre_tokenize_str
    points = [p for p in range(LAST_CODE_POINT + 1) if not 0xD800 <= p <= 0xDFFF and p != 0x20]
    text = "".join(map(chr, points))
    firsts, classes = [], []
    for _, (start, _) in split(text):
        mark = text[start]
        kind = next((k for k, before in ((LETTER, "x"), (NUMBER, "1"), (OTHER, "!")) if len(split(before + mark)) == 1), SPACE)
        if not classes or classes[-1] != kind:
            firsts.append(points[start])
            classes.append(kind)
    return np.array(firsts, np.int64), np.array(classes, np.uint8)


class PrefixEncoder:
    """Counts of tokens at prefixes, for a byte-level vocabulary given as its JSON text."""

    def __init__(self, content: str, runs: tuple[np.ndarray, np.ndarray]) -> None:
        parts = json.loads(content)
        model, splitter = parts["model"], parts["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or parts["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not plain:
            raise ValueError("prefix counts need a plain byte-level BPE vocabulary")
        special = parts["added_tokens"]
        if len(special) > 1 or any(t[k] for t in special for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("prefix counts need at most one special string, without options")
        self.special = special[0]["content"] if special else None
        letters = byte_letters()
        names = {text: i for text, i in model["vocab"].items() if all(c in letters for c in text)}
        self.token = {bytes(letters[c] for c in text): i for text, i in names.items()}
        self.merge, self.rank, self.parts = {}, {i: -1 for i in names.values()}, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = names[left + right]
            if self.rank[made] >= 0 or names[left] << 32 | names[right] in self.merge:
                raise ValueError("prefix counts need one merge for each token")
            self.merge[names[left] << 32 | names[right]] = self.rank[made] = rank
            self.parts[made] = (names[left], names[right])
        self.single = [self.token[bytes([b])] for b in range(256)]
        self.beginnings = {raw[:i] for raw in self.token for i in range(len(raw))}
        ends: dict[bytes, set[int]] = {}
        for raw in self.token:
            if len(raw) > 1:
                ends.setdefault(raw[-2:], set()).add(len(raw))
        self.ends = {end: tuple(sorted(lengths, reverse=True)) for end, lengths in ends.items()}
        self.pairs: dict[int, bool] = {}
        self.pair_bits, self.pair_keys, self.pair_right = 0, None, None
        self.index_pairs({})
        # the tokens as a tree: node 0 is its top, and also what no token leads to
        node = {b"": 0}
        for raw in sorted(self.token, key=len):
            for i in range(1, len(raw) + 1):
                node.setdefault(raw[:i], len(node))
        self.tree = np.zeros((len(node), 256), np.int32)
        self.at_node = np.full(len(node), -1, np.int64)
        for raw, i in node.items():
            if raw:
                self.tree[node[raw[:-1]], raw[-1]] = i
                self.at_node[i] = self.token.get(raw, -1)
        self.table = np.full(LAST_CODE_POINT + 1, SPACE, np.uint8)
        for first, after, kind in zip(runs[0], [*runs[0][1:], LAST_CODE_POINT + 1], runs[1]):
            self.table[first:after] = kind
        self.table[0x20] = SPACE
        self.known: dict[bytes, bytes] = {}

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together.

        Walks back through the merges that made the two, the latest first: had a merge across
        the seam come before the one just undone, it would have been made instead. Of equal
        merges the one further left comes first.
        """
        merge, parts, undone, from_right = self.merge, self.parts, len(self.merge), False
        while True:
            across = merge.get(left << 32 | right)
            if across is not None and (across < undone or across == undone and from_right):
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                undone, from_right, left = a, False, parts[left][1]
            else:
                undone, from_right, right = b, True, parts[right][0]

    def count_bytes(self, piece: bytes) -> list[int]:
        """The number of tokens of the prefixes of 0, 1, 2, ... bytes of a piece."""
        token, pairs, ends, beginnings = self.token, self.pairs, self.ends, self.beginnings
        last, count, whole = [-1], [0], True
        for end in range(1, len(piece) + 1):
            if whole:
                prefix = piece[:end]
                right = token.get(prefix)
                if right is not None:
                    last.append(right)
                    count.append(1)
                    continue
                whole = prefix in beginnings
            chosen, before = -1, end - 1
            for length in ends.get(piece[end - 2 : end], ()):
                if length < end:
                    right = token.get(piece[end - length : end])
                    if right is not None:
                        pair = last[end - length] << 32 | right
                        fits = pairs.get(pair)
                        if fits is None:
                            fits = self.neighbours(last[end - length], right)
                            pairs[pair] = fits
                            self.index_pairs({pair: fits})
                        if fits:
                            chosen, before = right, end - length
                            break
            last.append(chosen if chosen >= 0 else self.single[piece[end - 1]])
            count.append(count[before] + 1)
        return count

    def count_many(self, pieces: list[bytes]) -> list[bytes]:
        """``count_bytes`` for many pieces of at most ``SHORT`` bytes at once: at each place, for all that reach it.

        Returns for each piece the counts at its code points, as integers of 4 bytes.
        """
        width, lengths = max(map(len, pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lengths, kind="stable")
        letters = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)[order]
        reach = len(pieces) - np.searchsorted(np.sort(lengths), np.arange(width), "right")
        last = np.full((width + 1, len(pieces)), -1, np.int64)
        count = np.zeros((width + 1, len(pieces)), np.uint8)
        alive: list[tuple[int, np.ndarray, np.ndarray]] = []  # start, rows, nodes of the tree of tokens
        for at in range(width):
            rows = int(reach[at])
            byte = letters[:rows, at]
            chosen, tokens = np.full(rows, -1, np.int64), np.zeros(rows, np.uint8)
            alive.append((at, np.arange(rows), np.zeros(rows, np.int32)))
            grown = []
            for start, own, node in alive:  # the longest token first
                if own[-1] >= rows:
                    keep = np.searchsorted(own, rows)
                    own, node = own[:keep], node[:keep]
                node = self.tree[node, byte[own]]
                some = node > 0
                own, node = own[some], node[some]
                if not len(own):
                    continue
                grown.append((start, own, node))
                token = self.at_node[node]
                some = (token >= 0) & (chosen[own] < 0)
                who, token = own[some], token[some]
                if start:
                    fits = self.table_of_pairs(last[start, who] << 32 | token)
                    who, token = who[fits], token[fits]
                chosen[who], tokens[who] = token, count[start, who] + 1
            alive = grown
            last[at + 1, :rows], count[at + 1, :rows] = chosen, tokens
        ends = np.arange(width) < lengths[order][:, None]
        ends[:, :-1] &= (letters[:, 1:] & 0xC0 != 0x80) | (np.arange(1, width) >= lengths[order][:, None])
        flat = count[1:].T[ends].astype(np.int32).tobytes()
        bounds = 4 * np.append(0, np.cumsum(ends.sum(axis=1)))
        out = [b""] * len(pieces)
        for piece, first, after in zip(order.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            out[piece] = flat[first:after]
        return out

    def table_of_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """``neighbours`` for many pairs, from a hash table of those met before."""
        keys, right = self.pair_keys, self.pair_right
        place = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.pair_bits)).astype(np.int64)
        todo = np.arange(len(pairs))
        while len(todo):
            found = keys[place[todo]]
            todo = todo[(found != pairs[todo]) & (found >= 0)]
            place[todo] = (place[todo] + 1) & (len(keys) - 1)
        new = np.unique(pairs[keys[place] < 0])
        if len(new):
            told = {p: self.neighbours(p >> 32, p & 0xFFFFFFFF) for p in new.tolist()}
            self.pairs.update(told)
            self.index_pairs(told)
            return self.table_of_pairs(pairs)
        return right[place]

    def index_pairs(self, new: dict[int, bool]) -> None:
        """Add pairs to the open hash table, which is laid out anew when it is half full."""
        bits = max(12, (2 * len(self.pairs)).bit_length())
        if bits != self.pair_bits:
            new = self.pairs
            self.pair_bits, self.pair_keys, self.pair_right = bits, np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)
        keys, right = self.pair_keys, self.pair_right
        pairs, fits = np.fromiter(new.keys(), np.int64, len(new)), np.fromiter(new.values(), bool, len(new))
        place = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        while len(pairs):
            free = keys[place] < 0
            keys[place[free]] = pairs[free]  # of several for one place the last stays
            mine = keys[place] == pairs
            right[place[mine]] = fits[mine]
            pairs, fits, place = pairs[~mine], fits[~mine], (place[~mine] + 1) & (len(keys) - 1)
    def learn(self, pieces: list[bytes]) -> None:
        """Counts at the code points of pieces not met before."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = pieces
        short = [p for p in new if len(p) <= SHORT]
        if short:
            self.known.update(zip(short, self.count_many(short)))
        for piece in new:
            if len(piece) > SHORT:
                count = self.count_bytes(piece)
                ends = (i for i in range(1, len(piece) + 1) if i == len(piece) or piece[i] & 0xC0 != 0x80)
                self.known[piece] = np.array([count[i] for i in ends], np.int32).tobytes()

    def plain_counts(self, texts: list[str]) -> np.ndarray:
        """Counts after each code point of plain texts, one text after the other."""
        joined = "".join(texts)
        if not joined:
            return np.empty(0, np.int32)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        raw = joined.encode()
        kinds, n = self.table[points], len(points)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text_ends = np.cumsum(sizes)
        first = np.zeros(n + 1, bool)
        first[0] = True
        first[text_ends] = True
        edge = first[:n].copy()
        edge[1:] |= kinds[1:] != kinds[:-1]
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], n)
        kind, final = kinds[starts], first[ends]
        follows = np.append(False, ~final[:-1])  # the run before is of the same text
        spaced = points[ends - 1] == 0x20
        inner = (kind == SPACE) & ~final
        # pieces begin where runs do; a blank belongs to the run after it
        begins = edge.copy()
        begins[ends[inner] - 1] = True
        joins = np.append(False, (inner & spaced)[:-1]) & follows
        begins[starts[joins]] = False
        half = np.empty(0, np.int64)
        marks = np.flatnonzero((kind == OTHER) & (ends - starts == 1) & (points[starts] == ord("'")) & ~joins & ~final)
        marks = marks[kind[np.minimum(marks + 1, len(kind) - 1)] == LETTER] if len(marks) else marks
        if len(marks):
            at, room = starts[marks + 1], ends[marks + 1] - starts[marks + 1]
            one, two = points[at], points[np.minimum(at + 1, n - 1)]
            short = np.isin(one, [ord(c) for c in SHORT_ENDINGS])
            long = np.zeros(len(at), bool)
            for a, b in LONG_ENDINGS:
                long |= (one == ord(a)) & (two == ord(b)) & (room >= 2)
            long &= ~short
            length = np.where(short, 1, 2)
            use = short | long
            at, room, length = at[use], room[use], length[use]
            begins[at] = False
            more = room > length
            begins[(at + length)[more]] = True
            half = at[length == 2]  # a prefix that ends here has half of an ending
        piece_at = np.flatnonzero(begins)
        lengths = np.diff(np.append(piece_at, n))
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.append(0, np.cumsum(width))
        offsets = np.append(byte_at[piece_at], byte_at[n])
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(piece_at), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        blank = np.flatnonzero(inner & (ends - starts >= 2))
        blanks = [raw[a:b] for a, b in zip(byte_at[starts[blank]].tolist(), byte_at[ends[blank]].tolist())]
        self.learn(distinct + list(set(blanks)))
        kept = [self.known[p] for p in distinct]
        flat = np.frombuffer(b"".join(kept), np.int32)
        bounds = np.cumsum([0] + [len(k) // 4 for k in kept])
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        whole = flat[bounds[1:] - 1][codes].astype(np.int64)
        before = np.cumsum(whole) - whole
        # counts begin anew with each text
        text_of = np.repeat(np.arange(len(texts)), sizes)[piece_at]
        new = np.append(True, text_of[1:] != text_of[:-1])
        before -= before[np.flatnonzero(new)][np.cumsum(new) - 1]
        counts = flat[np.arange(n) - np.repeat(piece_at - bounds[codes], lengths)] + np.repeat(before, lengths).astype(np.int32)
        if len(blanks):
            base = before[np.searchsorted(piece_at, starts[blank])]
            own = np.array([np.frombuffer(self.known[b], np.int32)[-1] for b in blanks])
            counts[ends[blank] - 1] = base + own
        if len(half):
            counts[half] = counts[half - 1] + 1
        return counts

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the number of tokens of its prefixes of 1, 2, ... code points."""
        special, parts, shape = self.special, [], []
        for text in texts:
            pieces = text.split(special) if special else [text]
            shape.append([len(p) for p in pieces])
            parts += [p + special[:-1] for p in pieces[:-1]] + [pieces[-1]]
        flat, at, out = self.plain_counts(parts), 0, []
        for lengths in shape:
            if len(lengths) == 1:
                out.append(flat[at : at + lengths[0]])
                at += lengths[0]
                continue
            got, base = [], 0
            for i, length in enumerate(lengths):
                with_tail = length + (len(special) - 1) * (i + 1 < len(lengths))
                own = flat[at : at + with_tail]
                at += with_tail
                got.append(own + base)
                if i + 1 < len(lengths):
                    base += (int(own[length - 1]) if length else 0) + 1
                    got.append(np.array([base], np.int32))
            out.append(np.concatenate(got))
        return out


def packed(counts: np.ndarray, codec: pa.Codec) -> bytes:
    """Differences of neighbouring counts, in as few bytes as they need, compressed. Sizes come first."""
    steps = np.diff(counts, prepend=0)
    width = next(w for w in (1, 2, 4) if not len(steps) or (steps.min() >= -(1 << 8 * w - 1) and steps.max() < 1 << 8 * w - 1))
    return np.array([len(steps), width], "<i8").tobytes() + codec.compress(steps.astype(f"<i{width}").tobytes(), asbytes=True)


def unpacked(stored: bytes) -> np.ndarray:
    """The counts of the prefixes of 0, 1, 2, ... code points."""
    n, width = np.frombuffer(stored[:16], "<i8").tolist()
    steps = np.frombuffer(pa.Codec("zstd").decompress(stored[16:], n * width, asbytes=True), f"<i{width}") if n else []
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)]).astype(np.int64)


def tokens_upto(stored: bytes, points: int) -> int:
    """Tokens of the prefix of so many code points (of the whole text, if that is shorter)."""
    counts = unpacked(stored)
    return int(counts[min(max(points, 0), len(counts) - 1)])


def longest_within(stored: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens. A longer prefix may have fewer tokens."""
    return int(np.flatnonzero(unpacked(stored) <= max(budget, 0))[-1])


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``prefix`` (see ``unpacked``) for every row of ``docs`` (doc_id, text).

    ``path`` names the vocabulary's JSON file, which the driver reads.
    """
    with open(path, encoding="utf-8") as file:
        content = file.read()
    runs = character_classes(content)

    def run(batches):
        encoder, codec = PrefixEncoder(content, runs), pa.Codec("zstd", 1)
        for piece in slices(batches, "text", 1 << 20):
            texts = [t or "" for t in piece.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes, pa.int64()), pa.array([packed(c, codec) for c in encoder.counts(texts)], pa.binary())], names=["doc_id", "n_bytes", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, prefix binary")


def within_budget(stored: DataFrame, budget: int) -> DataFrame:
    """Replace ``prefix`` by ``n_tokens``, ``over_limit`` (more than ``budget``) and ``fit_chars`` (longest prefix within it)."""
    kept = [f for f in stored.schema.fields if f.name not in ("prefix", "n_tokens", "over_limit", "fit_chars")]
    names = [f.name for f in kept] + ["n_tokens", "over_limit", "fit_chars"]

    def run(batches):
        for batch in batches:
            total, fit = [], []
            for one in batch.column(batch.num_columns - 1):
                counts = unpacked(one.as_py())
                total.append(int(counts[-1]))
                fit.append(int(np.flatnonzero(counts <= max(budget, 0))[-1]))
            answers = [pa.array(total, pa.int64()), pa.array([n > budget for n in total], pa.bool_()), pa.array(fit, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + answers, names=names)

    added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return stored.select(*[f"`{f.name}`" for f in kept], "prefix").mapInArrow(run, f"{added}, n_tokens long, over_limit boolean, fit_chars long")


@query("op13_token_counts")
def op13_token_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return within_budget(prefix_counts(docs, public_tokenizers.path(VOCABULARY)), LIMIT)
