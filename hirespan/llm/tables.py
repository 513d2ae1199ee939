"""Reading the given tables, and folders that all executors can reach."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_LOCAL: dict[str, str] = {}  # by application


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, as in local tests, a temporary folder serves; a session whose executors run
    elsewhere is refused then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="hirespan-")
        root = _LOCAL[context.applicationId]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


Query = Callable[[SparkSession, str], DataFrame]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what Spark hands to a Python worker at once, in rows and in bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def give_back() -> None:
    """Hand what this process has freed back to the system, where the C library offers that."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, with unused memory given back as its task ends.

    Python workers outlive their tasks: those of one stage sit in the same executor as those of the next.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tasks


def set_aside(docs: DataFrame, names: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that bear one of the inner ``names`` renamed, and how to rename them back."""
    moved = {c: f"{c} of the input" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(moved), {new: old for old, new in moved.items()}
