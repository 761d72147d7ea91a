"""The queries of the numbered operators, each with its DuckDB oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under ``key``."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from garbline.llm import (  # noqa: F401
        decontamination,
        fingerprints,
        language,
        mixing,
        ngram_join,
        personal,
        prefix_trie,
        resampling,
        secrets,
        token_counts,
        toxicity,
        training_order,
        whitening,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLES)
