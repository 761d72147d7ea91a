"""Tables in the shared folder that are dealt into buckets by key, so a micro-batch reads what its keys touch."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from garbline.session import scratch_path

BUCKETS = 64


class KeyedTable:
    """Rows at ``root`` under one folder for each bucket of the hash of ``keys``, below it one for each batch.

    Buckets are folders, so reading some of them lists and opens nothing of the others. What
    reaches the driver is the list of touched buckets, at most ``buckets`` numbers. A key always
    falls into the same bucket: choose ``buckets`` once, for the size that a batch may read of
    one key's neighbours.
    """

    def __init__(self, spark: SparkSession, keys: list[str], schema: StructType, root: str | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.keys, self.schema, self.buckets = spark, keys, schema, buckets
        self.root = root or scratch_path(spark, "keyed")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast(self.schema[k].dataType) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, batch: int = 0) -> None:
        """Write the rows of a batch; writing a batch again replaces its first attempt."""
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        dealt = shaped.withColumn("bucket", self.bucket()).withColumn("batch", F.lit(batch).cast("bigint"))
        (
            dealt.repartition("bucket")
            .sortWithinPartitions("bucket", *self.keys)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "batch")
            .parquet(self.root)
        )

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of ``rows`` fall into."""
        return [r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect()]

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of some buckets (all), of batches earlier than ``before`` (all)."""
        found = self._folders()
        paths = [f"{self.root}/bucket={b}" for b in sorted(found if buckets is None else found & set(buckets))]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        shape = StructType(list(self.schema.fields)).add("bucket", "integer").add("batch", "long")
        rows = self.spark.read.schema(shape).option("basePath", self.root).parquet(*paths)
        return (rows if before is None else rows.where(F.col("batch") < before)).select(*self.schema.names)

    def near(self, rows: DataFrame) -> DataFrame:
        """What a join with ``rows`` on the keys can meet."""
        return self.read(self.touched(rows))

    def insert_absent(self, rows: DataFrame, batch: int) -> None:
        """Add the rows of a batch whose keys no earlier batch has brought; of equal keys, NULL too, one row."""
        once = rows.dropDuplicates(self.keys).persist()
        try:
            known = self.read(self.touched(once), before=batch).select(*[F.col(k).alias(f"_known_{k}") for k in self.keys])
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in self.keys])
            self.write(once.join(known, same, "left_anti"), batch)
        finally:
            once.unpersist()

    def _folders(self) -> set[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return set()
        names = [status.getPath().getName() for status in files.listStatus(path)]
        return {int(name.split("=")[1]) for name in names if name.startswith("bucket=")}


def keyed_copy(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> KeyedTable:
    """``df`` as a table of buckets, written once before a stream that looks rows up by ``keys``."""
    table = KeyedTable(df.sparkSession, keys, df.schema, buckets=buckets)
    table.write(df)
    return table
