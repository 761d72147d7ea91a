"""Classify a measure into named bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(col: Column, cuts: list, labels: list[str], upper_closed: bool = True) -> Column:
    """``labels[i]`` where ``col`` is at or below ``cuts[i]`` (below it, if not ``upper_closed``)."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("one label more than cuts")
    chain = F.when(col.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        chain = chain.when(col <= cut if upper_closed else col < cut, label)
    return chain.otherwise(labels[-1])
