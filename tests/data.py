"""Small hand-made domain tables."""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

from garbline.schemas import SCHEMAS


def ddl(table: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in SCHEMAS[table].items())


def table(spark, name: str, rows: list[dict]):
    columns = list(SCHEMAS[name])
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ddl(name))


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def tables(spark, **given) -> SimpleNamespace:
    """All domain tables; those not given are empty."""
    return SimpleNamespace(spark=spark, **{n: table(spark, n, given.get(n, [])) for n in SCHEMAS})


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
