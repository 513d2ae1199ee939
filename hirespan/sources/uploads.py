"""Uploaded resume files: the checks at the door."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted types, smallest file, first bytes.
ACCEPTED_TYPES = ["pdf", "octet-stream"]
SMALLEST, MAGIC = 5, "%PDF"


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the files in a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def check_uploads(uploads: DataFrame) -> DataFrame:
    """Add size, checksum and the reason for refusal (null if accepted).

    ``uploads`` has ``content_type, content`` beside its own columns; content is not kept.
    """
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    known: Column = F.lit(False)
    for accepted in ACCEPTED_TYPES:
        known = known | kind.contains(accepted)
    size = F.length("content")
    starts = F.substring("content", 1, len(MAGIC)) == F.encode(F.lit(MAGIC), "utf-8")
    reason = (
        F.when(F.coalesce(size, F.lit(0)) == 0, "file is empty")
        .when(~known, "type not supported")
        .when((size < SMALLEST) | ~starts, "not a pdf")
    )
    return uploads.select(
        *[c for c in uploads.columns if c != "content"],
        size.cast("long").alias("file_size_bytes"),
        F.sha2("content", 256).alias("checksum_sha256"),
        reason.alias("reason"),
    )
