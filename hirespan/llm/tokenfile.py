"""Token ids as Arrow files of equal-length sequences, which are read without copying.

Documents are dealt out by ranges of their id and sorted, so files in order of their number hold the ids
in ascending order. A file holds the ids of whole documents end to end, in rows of ``LENGTH`` ids
(fixed-size lists, 16-bit if the vocabulary allows) with a mask that is false where the last row is
padded. Every record batch but the last has ``ROWS`` rows, so the row of any id is a division away, and
a memory-mapped file gives it without reading what is before.

Files are written under the attempt's own name, and the index of documents, written by Spark, names the
attempt that counted: a repeated task leaves a file nobody refers to. Only ids of one part of a batch and
less than ``ROWS`` rows are held at a time.

Defined results: a null or empty text is its end id alone; equal ids (repeated rows) follow each other;
null ids come first; an empty table gives an empty index; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirespan.llm import tokens
from hirespan.llm.tables import small_batches

LENGTH, ROWS = 2048, 256
RECORDS, SLICE = 5000, 16 << 20  # documents, and bytes of them, that are encoded at once
INDEX = "doc_id long, file string, first long, n_tokens long"


def file_schema(vocabulary: int, length: int = LENGTH) -> pa.Schema:
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class Writer:
    """One file; ids come in any portions."""

    def __init__(self, folder: str, name: str, vocabulary: int) -> None:
        self.schema = file_schema(vocabulary)
        self.kind = self.schema.field("ids").type.value_type.to_pandas_dtype()
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        self.sink = system.open_output_stream(f"{path}/{name}")
        self.file = ipc.new_file(self.sink, self.schema)
        self.rest = np.empty(0, self.kind)
        self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids.astype(self.kind)])
        whole = len(ids) // (LENGTH * ROWS) * (LENGTH * ROWS)
        for at in range(0, whole, LENGTH * ROWS):
            self._rows(ids[at : at + LENGTH * ROWS], LENGTH * ROWS)
        self.rest = ids[whole:]

    def _rows(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), LENGTH) for x in (ids, mask)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            self._rows(np.pad(self.rest, (0, -len(self.rest) % LENGTH)), len(self.rest))
        self.file.close()
        self.sink.close()


class Reader:
    """Random access to a file's ids; local files are memory-mapped."""

    def __init__(self, path: str) -> None:
        system, inner = fs.FileSystem.from_uri(path)
        local = isinstance(system, fs.LocalFileSystem)
        self.file = ipc.open_file(pa.memory_map(inner) if local else system.open_input_file(inner))
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0))  # the record batch read last

    def ids(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from the ``first`` on."""
        each, found = LENGTH * ROWS, []
        for k in range(first // each, (first + count - 1) // each + 1 if count else 0):
            if self.held[0] != k:
                self.held = (k, self.file.get_batch(k).column("ids").values.to_numpy())
            values = self.held[1]
            found.append(values[max(0, first - k * each) : first + count - k * each])
        return np.concatenate(found) if len(found) != 1 else found[0]

    def real(self) -> int:
        """Ids that the masks let through."""
        return sum(self.file.get_batch(k).column("mask").values.true_count for k in range(self.file.num_record_batches))


def write(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents' ids to ``folder/files`` and return their index, which lies in ``folder/index``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = tokens.encoder(tokenizer), TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
        writer = None
        for batch in batches:
            for some in tokens.parts_of(batch, "text", SLICE):
                writer = writer or Writer(f"{folder}/files", name, coder.tokenizer.get_vocab_size())
                first = writer.total
                ids, starts = tokens.with_end(*coder.encode(some.column("text")))
                writer.add(ids)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": some.column("doc_id"),
                        "file": pa.array([name] * some.num_rows, pa.string()),
                        "first": pa.array(first + starts[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(starts), pa.int64()),
                    }
                )
        if writer:
            writer.close()

    spark = docs.sparkSession
    small_batches(spark, RECORDS)
    ordered = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text")
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def placed(index: DataFrame) -> DataFrame:
    """The index with ``start``: ids of all documents before it. One row per file is summed up."""
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    return index.join(files, "file").withColumn("start", F.col("before") + F.col("first")).drop("before")


def read_back(placed_index: DataFrame, folder: str) -> DataFrame:
    """Per document its ``start``, ``n_tokens`` and the crc32 of its ids as unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = lru_cache(maxsize=4)(Reader)
        for batch in batches:
            names = batch.column("file").to_pylist()
            firsts, sizes = batch.column("first").to_pylist(), batch.column("n_tokens").to_pylist()
            found = [opened(f"{folder}/files/{n}").ids(f, s) for n, f, s in zip(names, firsts, sizes, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "start": batch.column("start"),
                    "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                }
            )

    return placed_index.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
