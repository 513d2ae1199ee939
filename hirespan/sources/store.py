"""Tables in Parquet.

Plain Parquet has no row updates. Small tables which change are written whole, as numbered versions, of
which a folder counts only once complete; so a lost executor or a repeated batch does no harm. Large ones
are laid out in buckets (``hirespan.sources.buckets``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from hirespan.session import shared_folder


def check_schema(frame: DataFrame, schema: StructType) -> DataFrame:
    """The frame's columns in schema order; a missing column or other type is an error."""
    found = {field.name: field.dataType for field in frame.schema}
    wrong = [
        f"{field.name}: {found.get(field.name)} instead of {field.dataType}"
        for field in schema
        if found.get(field.name) != field.dataType
    ]
    if wrong:
        raise ValueError("table does not match its schema: " + "; ".join(wrong))
    return frame.select(*schema.names)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A Parquet table, its types checked and never inferred from values."""
    frame = spark.read.parquet(path)
    return frame if schema is None else check_schema(frame, schema)


def write_table(frame: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = frame.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """``frame`` as a table in the shared folder, for rows that are used several times but worked out once."""
    path = shared_folder(frame.sparkSession, purpose)
    write_table(frame, path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def has_rows(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table, oldest first."""
    place, files = _filesystem(spark, path)
    if not files.exists(place):
        return []
    found = []
    for status in files.listStatus(place):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v=") and files.exists(done):
            found.append(int(name[2:]))
    return sorted(found)


def read_version(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (older than ``before``), or None."""
    known = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v={known[-1]:012d}") if known else None


def write_version(frame: DataFrame, path: str, version: int) -> None:
    frame.write.mode("overwrite").parquet(f"{path}/v={version:012d}")


def drop_versions(spark: SparkSession, path: str, before: int) -> None:
    """Remove the complete versions older than ``before``."""
    for number in versions(spark, path):
        if number < before:
            place, files = _filesystem(spark, f"{path}/v={number:012d}")
            files.delete(place, True)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that is used no more."""
    place, files = _filesystem(spark, path)
    files.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _filesystem(spark, path)
    return files.exists(place)
