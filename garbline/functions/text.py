"""Text and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from garbline.schemas import RETURNED_PREFIX

# Fixed labels of the returns page; any other reason is shown in title case.
REASON_LABELS = {
    "stolen": "Stolen",
    "lost": "Lost",
    "worn_out": "Worn out",
    "damaged": "Damaged",
    "size_exchange": "Size exchange",
}


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def contains_text(col: Column, text: str) -> Column:
    """Case-insensitive literal substring test; NULL counts as empty."""
    return F.contains(F.lower(F.coalesce(col, F.lit(""))), F.lower(F.lit(text)))


def status_label(status: Column) -> Column:
    return F.when(status == "completed", "Sent").otherwise(F.initcap(status))


def words_label(code: Column) -> Column:
    """``size_exchange`` -> ``Size Exchange``."""
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def reason_label(reason: Column) -> Column:
    label = F.when(F.coalesce(reason, F.lit("")) == "", "Other")
    for code, text in REASON_LABELS.items():
        label = label.when(reason == code, text)
    return label.otherwise(words_label(reason))


def return_reason(status: Column) -> Column:
    """The status without its prefix where it has one; every occurrence is removed."""
    stripped = F.replace(status, F.lit(RETURNED_PREFIX), F.lit(""))
    return F.when(F.startswith(status, F.lit(RETURNED_PREFIX)), stripped).otherwise(status)


def excerpt(col: Column, size: int = 200) -> Column:
    return F.when(F.length(col) > size, F.concat(F.substring(col, 1, size), F.lit("…"))).otherwise(col)


def dash_if_empty(col: Column) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit("-"))


def money_text(col: Column, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f", col.cast("double"))


def is_digits(col: Column) -> Column:
    return F.coalesce(F.rlike(col, F.lit("^[0-9]+$")), F.lit(False))
