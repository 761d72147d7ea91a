"""Load domain tables stored one directory per table, or behind JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garbline.functions.text import blank_to_null
from garbline.schemas import SCHEMAS, conform


def load(spark: SparkSession, path: str, tables=None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All domain tables under ``path``, checked against their declared schemas."""
    return {
        name: conform(spark.read.format(fmt).load(f"{path}/{name}"), name)
        for name in (tables or SCHEMAS)
    }


def load_text(spark: SparkSession, path: str, table: str, fmt: str = "csv") -> DataFrame:
    """One domain table from CSV or JSON text; blank strings become NULL."""
    columns = list(SCHEMAS[table])
    as_text = ", ".join(f"{c} STRING" for c in columns)
    reader = spark.read.schema(as_text)
    raw = reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)
    return conform(raw.select(*[blank_to_null(F.col(c)).alias(c) for c in columns]), table)


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str = "id",
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """One domain table from a database, read in parallel ranges of ``key`` when bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for name, value in (properties or {}).items():
        reader = reader.option(name, value)
    if bounds is not None:
        reader = (
            reader.option("partitionColumn", key)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return conform(reader.load(), table)


def dimension(df: DataFrame, *order_by: str) -> DataFrame:
    """A sorted listing of a dimension table."""
    return df.orderBy(*order_by)
