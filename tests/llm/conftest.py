import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
# Names that the operators use themselves.
CLASHING = ["row", "cls", "score", "size", "start", "source_size", "label", "item", "id", "slot", "lang_pred", "component_id", "__row_key", "high"]


def write_tables(target, documents, labels=(), benchmark=(), clashing=False):
    """documents: (doc_id, text, lang, source); labels: (doc_id, quality, toxic); benchmark: (item_id, text)."""
    rows = [dict(zip(SCHEMA.names, (*d, len(d[1]) if d[1] is not None else None))) for d in documents]
    schema = SCHEMA
    if clashing:
        for name in CLASHING:
            schema = schema.append(pa.field(name, pa.string()))
        rows = [r | {name: f"{name}-{i}" for name in CLASHING} for i, r in enumerate(rows)]
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), f"{target}/documents.parquet")
    names = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
    pq.write_table(pa.Table.from_pylist([dict(zip(names.names, x)) for x in labels], schema=names), f"{target}/labels.parquet")
    names = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
    pq.write_table(pa.Table.from_pylist([dict(zip(names.names, x)) for x in benchmark], schema=names), f"{target}/benchmark.parquet")
    names = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    pq.write_table(names.empty_table(), f"{target}/conversations.parquet")
    names = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])
    pq.write_table(names.empty_table(), f"{target}/embeddings.parquet")
    return str(target)


LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n ", None, None),
    (4, "one", "en", None),
    (5, "the cat sat on the mat and then it ran away from the dog", "en", "b"),
    (5, "the cat sat on the mat and then it ran away from the dog", "en", "b"),
    (5, "another text under the same number of the document", "en", "b"),
    (6, "the cat sat on the mat and then it ran away from the dog", "en", "c"),
    (None, "a row without a number, but with words in it", "en", "c"),
    (None, None, None, None),
    (7, LONG, "en", "c"),
    (8, "x" * 120_000, "en", "c"),
    (9, "12 345 !! ?? ...", "de", "d"),
    (10, "der hund und die katze gehen nicht in das haus und \U0001f600 sind froh", "de", "d"),
    (11, "0" * 50_000 + "@" * 2_000 + "+" * 2_000 + " a@" + "." * 5_000, "de", "d"),
]
ODD_LABELS = [(5, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (7, 1, 0), (10, 0, 0), (99, 1, 1)]
ODD_ITEMS = [(1, "The cat sat on the mat, and then it RAN away from the dog!"), (1, None), (None, "der hund und die katze gehen nicht in das haus"), (3, ""), (4, "too short")]


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("odd"), ODD, ODD_LABELS, ODD_ITEMS, clashing=True)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), [])


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark, small_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
