"""Prefix counts against the library, prefix by prefix."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from garbline.llm import registry
from garbline.llm.token_counts import SHORT, VOCABULARY, PrefixEncoder, character_classes, longest_within, prefix_counts, tokens_upto, unpacked, within_budget

PATH = public_tokenizers.path(VOCABULARY)
PARTS = [
    "'s", "'re", "'r", "'v", "'l", "'ll", "'", "a", "the", " ", " ", "  ", "\n", "\n\n", "\t", " ", "　", "1", "23", "!", "<|endoftext|>", "<|endof", "é", "日本", "\U0001f600",
    "hello", "HELLO", "x" * 9, "." * 5, "́", "ß", "ſ", "restaurant", " 're", "'restaurant", "ab" * SHORT,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        content = file.read()
    return PrefixEncoder(content, character_classes(content))


def wanted(library, text):
    return [len(e.ids) for e in library.encode_batch([text[: i + 1] for i in range(len(text))], add_special_tokens=False)]


def test_every_prefix_of_random_texts(encoder, library):
    rnd = random.Random(13)
    for _ in range(400):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12)))
        first, _, again = encoder.counts([text, "ab", text])
        assert first.tolist() == wanted(library, text) == again.tolist()


def test_one_by_one_and_together_agree(encoder):
    rnd = random.Random(3)
    pieces = list({"".join(rnd.choice("aeinrst zq") for _ in range(rnd.randint(1, SHORT))).encode() for _ in range(500)})
    import numpy as np

    for piece, together in zip(pieces, encoder.count_many(pieces)):
        assert np.frombuffer(together, np.int32).tolist() == encoder.count_bytes(piece)[1:]


def test_every_code_point_is_of_the_librarys_class(library, encoder):
    """Each code point alone, after a letter, and before one."""
    points = [chr(p) for p in range(0x3000) if not 0xD800 <= p <= 0xDFFF] + [chr(p) for p in range(0x3000, 0x110000, 97) if not 0xD800 <= p <= 0xDFFF]
    texts = [f"x{c}y 1{c}2 !{c}?" for c in points]
    got = [c[-1] for c in encoder.counts(texts)]
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_pieces(encoder, library):
    for text in ["x" * 100_000, " " * 100_000 + "a", "0" * 50_000 + "é" * 20_000]:
        assert encoder.counts([text])[0][-1] == len(library.encode(text[:-1] + text[-1], add_special_tokens=False).ids)


def test_questions_about_prefixes(spark, library):
    text = "It's the restaurant's   best\n\n dish, isn't it? <|endoftext|> 12345 \U0001f600"
    docs = spark.createDataFrame([(1, text), (2, None), (None, ""), (1, text)], "doc_id long, text string")
    rows = prefix_counts(docs, PATH).collect()
    counts = [0] + wanted(library, text)
    assert sorted(r["n_bytes"] for r in rows) == [0, 0, len(text.encode()), len(text.encode())]
    for r in rows:
        own = counts if r["doc_id"] == 1 else [0]
        assert unpacked(r["prefix"]).tolist() == own
        for budget in range(len(own) + 2):
            fit = longest_within(r["prefix"], budget)
            assert own[fit] <= budget and all(c > budget for c in own[fit + 1 :])
            assert tokens_upto(r["prefix"], budget) == own[min(budget, len(own) - 1)]
    told = within_budget(prefix_counts(docs, PATH), 5).where("doc_id = 1").first()
    assert (told["n_tokens"], told["over_limit"]) == (counts[-1], counts[-1] > 5) and counts[told["fit_chars"]] <= 5


@pytest.mark.parametrize("kind", ["small_dir", "odd_dir", "empty_dir"])
def test_query_against_the_library(spark, request, library, kind):
    path = request.getfixturevalue(kind)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in registry.queries()["op13_token_counts"](spark, path).collect())
    texts = [(r["doc_id"] or -1, r["text"] or "") for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    sizes = [len(e.ids) for e in library.encode_batch([t for _, t in texts], add_special_tokens=False)]
    assert got == sorted((d, len(t.encode()), n, n > 1024) for (d, t), n in zip(texts, sizes))


def test_other_vocabularies_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        PrefixEncoder(file.read(), ([0], [0]))
