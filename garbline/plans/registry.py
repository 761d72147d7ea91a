"""Named queries over the derived domain tables, each with its DuckDB oracle where SQL can say it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from garbline.plans.views import with_views
from garbline.sources.domain import DomainTables

# "Now" and "me" of the registered queries.
AS_OF = dt.datetime(1998, 6, 15)
SUPERVISOR = 7
WORKER = 46
VIEWER_ROLE = "supervisor"
JOB_ROLE = 2
SEARCH = "RED"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a function of the domain tables under ``key``."""

    def register(build: Callable[[DomainTables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = lambda spark, path: build(DomainTables(spark, path))
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from garbline.plans import (  # noqa: F401
        job_queries,
        join_queries,
        listing_queries,
        nested_queries,
        report_queries,
        stream_queries,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return {key: with_views(sql) for key, sql in ORACLES.items()}
