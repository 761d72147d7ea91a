"""Date helpers. Every "now" is an argument; predicates stay ranges so they reach the scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(moment: dt.date | dt.datetime | str) -> Column:
    """A TIMESTAMP_NTZ literal; a bare date means midnight."""
    if isinstance(moment, str):
        moment = dt.datetime.fromisoformat(moment)
    if not isinstance(moment, dt.datetime):
        moment = dt.datetime(moment.year, moment.month, moment.day)
    return F.expr(f"TIMESTAMP_NTZ '{moment.isoformat(sep=' ')}'")


def day(moment: dt.date | dt.datetime | str) -> Column:
    """A DATE literal of the day of ``moment``."""
    if isinstance(moment, str):
        moment = dt.datetime.fromisoformat(moment)
    return F.expr(f"DATE '{moment:%Y-%m-%d}'")


def in_month(col: Column, as_of: dt.date | dt.datetime) -> Column:
    """``col`` lies in the calendar month of ``as_of``."""
    first = dt.datetime(as_of.year, as_of.month, 1)
    following = dt.datetime(as_of.year + as_of.month // 12, as_of.month % 12 + 1, 1)
    return (col >= ntz(first)) & (col < ntz(following))


def covers(start: Column, end: Column, as_of: dt.date | dt.datetime) -> Column:
    """The inclusive date range holds the day of ``as_of``."""
    return (start <= day(as_of)) & (end >= day(as_of))
