"""A quality score from compressed sizes: texts like the good ones pack better with a dictionary of good text.

Dictionaries for zstandard are built from labelled text of either kind, and a calibration fitted on
further labelled rows turns compressed sizes into the chance that a text is good. The measures of a
text are its sizes with either dictionary and with none, per byte: above all the normalised difference
of the first two. All are worked out block by block over the whole text, so none depends on its length.

A fit uses ``SAMPLE`` rows of each label, lowest hash of the id first: every other one for the dictionaries,
the rest for calibration. Texts are used whole. Those for a dictionary are read by the driver, as many of
them as ``BYTES`` hold; those for calibration are measured by tasks, which give back numbers. The model is
some hundred kilobytes and goes to the tasks with the function.

Defined results: a null or empty text gets the model's share of good rows; repeated rows get equal
scores; an empty table gives an empty one. Without rows of both labels every score is that share (0.5
without any). Columns are carried on unless they bear the name of a result. Labels other than 0 and 1,
nulls among them, are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirespan.llm.tables import small_batches, written

SAMPLE = 1500
BYTES = 8 << 20  # of texts of one label that a dictionary is made from
DICTIONARY = 48 << 10
BLOCK = 16 << 10
LEVEL = 3
THRESHOLD = 0.3


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of text: trained if there is enough of it, else the text itself."""
    blocks = [text[at : at + 1024] for text in texts for at in range(0, len(text), 1024)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:]


class Sizes:
    """Compressed sizes by the dictionaries of bad text, of good text and by none."""

    def __init__(self, dictionaries: tuple[bytes, bytes]) -> None:
        kinds = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) for d in dictionaries]
        settings = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.by = [zstandard.ZstdCompressor(dict_data=k, **settings) for k in kinds] + [zstandard.ZstdCompressor(**settings)]

    def measures(self, text: bytes) -> list[float]:
        size = [0, 0, 0]
        worst = 0.0
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK]
            bad, good, none = (len(c.compress(block)) for c in self.by)
            size = [size[0] + bad, size[1] + good, size[2] + none]
            worst = max(worst, (good - bad) / len(block))
        n = len(text)
        return [(size[1] - size[0]) / max(size[:2]), size[0] / n, size[1] / n, size[2] / n, worst, min(1.0, 100 / n)]


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[bytes, bytes]
    weights: tuple[float, ...]  # of the measures, standardised, and of their squares; the first is the constant
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    share: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if not self.weights:
            return out
        sizes = _sizes(self.dictionaries)
        there = [k for k, text in enumerate(texts) if text]
        if there:
            x = np.array([sizes.measures(texts[k].encode("utf-8", "replace")) for k in there])
            out[there] = 1 / (1 + np.exp(-np.clip(_expanded(x, self.mean, self.scale) @ np.array(self.weights), -40, 40)))
        return out


_KEPT: dict = {}


def _sizes(dictionaries: tuple[bytes, bytes]) -> Sizes:
    if dictionaries not in _KEPT:
        _KEPT.clear()
        _KEPT[dictionaries] = Sizes(dictionaries)
    return _KEPT[dictionaries]


def _expanded(x: np.ndarray, mean: tuple, scale: tuple) -> np.ndarray:
    z = np.clip((x - np.array(mean)) / np.array(scale), -6, 6)
    pairs = [z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i + 1)]
    return np.column_stack([np.ones(len(z)), z, *pairs])


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label") -> Model:
    """A model from the texts of ``docs`` and ``labels`` (id, label), label 1 for good.

    Ids are chosen from the labels alone; only the chosen rows' texts are read out.
    """
    spark = docs.sparkSession
    rows = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"), F.xxhash64(doc_id).alias("h")
    )
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    chosen = [r for y in (0, 1) for r in rows.where(F.col("y") == y).orderBy("h", "id").limit(SAMPLE).collect()]
    # At most twice SAMPLE rows are sent to all tasks. Rows of one id with different texts are one by one.
    chosen = spark.createDataFrame([(r["id"], r["y"], k % 2) for k, r in enumerate(chosen)], "id long, y int, half int")
    found = docs.where(F.col(text) != "").join(F.broadcast(chosen), F.col(doc_id) == F.col("id"))
    found = written(found.select("id", "y", "half", F.col(text).alias("t")).distinct(), "sample")
    sizes = found.where("half = 0").select("id", "y", F.octet_length("t").alias("n"), F.xxhash64("t").alias("h")).collect()
    texts = {y: _read(found, y, [r for r in sizes if r["y"] == y]) for y in (0, 1)}
    if not texts[0] or not texts[1]:
        return Model((b"", b""), (), (), (), share)
    dictionaries = (_dictionary(texts[0]), _dictionary(texts[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measures = [_sizes(dictionaries).measures(t.encode("utf-8", "replace")) for t in batch.column("t").to_pylist()]
            columns = {"id": batch.column("id"), "y": batch.column("y"), "half": batch.column("half"), "x": pa.array(measures, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(columns)

    small_batches(spark)
    rest = found.select("id", "y", "half", "t").mapInArrow(run, "id long, y int, half int, x array<double>").collect()
    rest = sorted(rest, key=lambda r: (r["y"], r["id"], r["x"]))
    rows = {y: [r for r in rest if r["y"] == y and r["half"]] or [r for r in rest if r["y"] == y] for y in (0, 1)}
    x = np.array([r["x"] for y in (0, 1) for r in rows[y]])
    y = np.repeat([0.0, 1.0], [len(rows[0]), len(rows[1])])
    # Each label weighs as much as it has among all labelled rows, so that scores are calibrated to them.
    weight = np.where(y == 1, share / len(rows[1]), (1 - share) / len(rows[0])) * len(y)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = _expanded(x, tuple(mean), tuple(scale))
    w = np.zeros(z.shape[1])
    for _ in range(60):  # Newton's steps of a logistic regression with a small penalty
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        slope = z.T @ (weight * (y - p)) - 0.05 * w
        curve = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + 0.05 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-7:
            break
    return Model(dictionaries, tuple(w.tolist()), tuple(mean.tolist()), tuple(scale.tolist()), share)


def _read(found: DataFrame, label: int, sizes: list) -> list[bytes]:
    """Whole texts of a label in the order of their ids, as many as ``BYTES`` hold."""
    held, wanted = 0, []
    for r in sorted(sizes, key=lambda r: (r["id"], r["h"])):
        if held + r["n"] <= BYTES:
            held += r["n"]
            wanted.append((r["id"], r["h"]))
    some = found.where((F.col("half") == 0) & (F.col("y") == label)).withColumn("h", F.xxhash64("t"))
    some = some.join(F.broadcast(found.sparkSession.createDataFrame(wanted, "id long, h long")), ["id", "h"]).collect()
    return [r["t"].encode("utf-8", "replace") for r in sorted(some, key=lambda r: (r["id"], r["h"]))]


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``."""
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.round(model.scores(batch.column(at).to_pylist()), 9)
            columns = [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "score", "predicted"])

    small_batches(docs.sparkSession)
    schema = docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return docs.mapInArrow(run, schema)
