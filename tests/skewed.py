"""A skewed copy of the test tables: one key of each kind holds a third of the rows.

Usage: python -m tests.skewed target_dir [sf_dir]; then python -m tests.oracle target_dir
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tests.oracle import TABLES

# table -> column -> (hot value, which third of the rows gets it)
HOT = {
    "lineitem": {"l_orderkey": (11, 0), "l_partkey": (5, 1), "l_suppkey": (3, 1), "l_linenumber": (2, 1)},
    "orders": {"o_custkey": (7, 0)},
    "events": {"user_id": (9, 0)},
}


def write_skewed(spark: SparkSession, target: str, sf_dir: str) -> None:
    for name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name in HOT:
            third = F.pmod(F.xxhash64(*df.columns), F.lit(3))
            df = df.select(third.alias("_third"), "*")
            for column, (value, which) in HOT[name].items():
                hot = F.when(F.col("_third") == which, F.lit(value)).otherwise(F.col(column))
                df = df.withColumn(column, hot.cast(df.schema[column].dataType))
            df = df.drop("_third")
        df.coalesce(1).write.parquet(f"{target}/_{name}")
        (part,) = [f for f in os.listdir(f"{target}/_{name}") if f.endswith(".parquet")]
        os.link(f"{target}/_{name}/{part}", f"{target}/{name}.parquet")


if __name__ == "__main__":
    from garbline.session import local_session

    write_skewed(local_session(), sys.argv[1], sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.001")
