"""Tables that change, laid out in hash buckets of their key.

A table is a folder of Parquet partitions, one per bucket, and a row's bucket is a hash of its key columns.
A batch reads the buckets that its own keys fall in and writes these anew, so what it reads and writes
depends on the batch and on the size of a bucket, not on how many batches came before. ``count`` fixes the
number of buckets when a table is made; take so many that a bucket is one file of fair size.

New buckets are written beside the table first (``stage``) and then over the old ones (``put``), by Spark's
dynamic overwrite of partitions. A batch that is handed over again after a failure finds what it staged and
puts it in place once more, without working anything out again. A table has one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from hirespan.sources.store import drop_versions, exists, versions


class Buckets:
    def __init__(self, path: str, keys: list[str], schema: str | StructType, count: int = 64) -> None:
        self.path, self.keys, self.count = path, keys, count
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int")

    def read(self, spark: SparkSession) -> DataFrame:
        """The whole table, empty before its first batch."""
        return self._in_place(spark).drop("bucket")

    def met_by(self, rows: DataFrame) -> DataFrame:
        """The rows of all buckets that the keys of ``rows`` fall in; at most ``count`` numbers are collected."""
        numbers = [r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect()]
        return self._in_place(rows.sparkSession).where(F.col("bucket").isin(numbers)).drop("bucket")

    def staged(self, spark: SparkSession, number: int) -> DataFrame | None:
        """What batch ``number`` staged, if that is complete."""
        if number not in versions(spark, f"{self.path}/staged"):
            return None
        return spark.read.schema(self._stored()).parquet(f"{self.path}/staged/v={number:012d}")

    def stage(self, rows: DataFrame, number: int) -> None:
        """Write ``rows``, whole buckets, beside the table. What earlier batches staged is in place by then and goes."""
        drop_versions(rows.sparkSession, f"{self.path}/staged", before=number)
        named = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], self.bucket().alias("bucket"))
        named.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/staged/v={number:012d}")

    def put(self, spark: SparkSession, number: int) -> None:
        """The staged buckets take the place of those of the table; they lie by bucket already, so nothing is shuffled."""
        writer = self.staged(spark, number).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(f"{self.path}/table")
        drop_versions(spark, f"{self.path}/staged", before=number)

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields, StructField("bucket", IntegerType())])

    def _in_place(self, spark: SparkSession) -> DataFrame:
        if not exists(spark, f"{self.path}/table"):
            return spark.createDataFrame([], self._stored())
        return spark.read.schema(self._stored()).parquet(f"{self.path}/table")
