"""The feed of new postings, and its newest twenty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirespan.sources.store import read_version, write_version

# Fixed value: postings shown in the rolling feed.
ROLLING = 20


def new_postings(stream: DataFrame, key: str) -> DataFrame:
    """Each posting once for as long as the stream lives, by key.

    Every key ever shown is state, spread over the executors by its hash and kept on disk; a watermark would
    bound it, but then a posting seen again later would be shown again.
    """
    return stream.where(F.col(key).isNotNull()).dropDuplicates([key])


def newest(rows: DataFrame, when: str, key: str, count: int = ROLLING) -> DataFrame:
    return rows.orderBy(F.col(when).desc(), F.col(key).desc()).limit(count)


def keep_newest(path: str, when: str, key: str, count: int = ROLLING):
    """A batch handler which keeps a table of the newest rows seen so far.

    Every batch writes version ``number``; doing a batch again writes the same version again.
    """

    def handle(batch: DataFrame, number: int) -> None:
        before = read_version(batch.sparkSession, path, before=number)
        rows = batch if before is None else batch.unionByName(before.select(*batch.columns))
        write_version(newest(rows, when, key, count), path, number)

    return handle
