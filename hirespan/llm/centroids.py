"""Clustering around centroids in whole numbers, with most distances ruled out in a few rotated coordinates.

Components become integers once. One pass sums first and second moments, whose eigenvectors (a 64 x 64
matrix at the driver) rotate the space; every vector is stored with its ``LEADING`` rotated coordinates and
the norm of what they leave out. For a vector x and a centroid c, the squared distance of the leading
coordinates plus the squared difference of the two residual norms is never above the squared distance of x
and c. So only centroids whose bound reaches the distance already found are looked at, and those are
verified in integers: the bound decides how much is worked out, never the result.

A round reads the written table of vectors, sums integers per centroid within each task, and hands ``k``
rows of sums a task to the shuffle; a centroid that holds most vectors is summed by all tasks alike. Only
centroids (``k`` vectors) pass the driver. A lost executor costs its tasks.

Defined results: a vector of another length, null, or with a null or non-finite component gives no row.
With fewer vectors than ``k`` there are fewer centroids. A null id is clustered but starts no centroid.
Repeated ids are vectors of their own; among equal hashes the smaller components come first; equal
centroids leave the later one empty. Components beyond 2**27 after scaling raise an error, as their
distances do not fit a long. An empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirespan.llm.tables import small_batches, written

SIZE, SCALE = 64, 256
CENTROIDS, ROUNDS, SEED = 40, 5, 2
LEADING = 12
LARGEST = 1 << 27  # 64 squares of differences up to twice that stay below 2**63
ROUNDING = 1e-9  # of squared norms; far above what double arithmetic loses in a bound
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole(vector: Column, size: int = SIZE, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as int, null unless all ``size`` components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)))
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * float(scale)) < float(LARGEST))
    scaled = F.when(fits, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large")))
    return F.when((F.size(vector) == size) & finite, scaled)


def rows_of(column: pa.Array, size: int) -> np.ndarray:
    """A column of lists with ``size`` numbers each as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class Rotation:
    """Orthonormal directions of greatest variance, about the mean."""

    def __init__(self, count: float, sums: np.ndarray, squares: np.ndarray, leading: int) -> None:
        self.mean = sums / max(count, 1.0)
        spread = squares / max(count, 1.0) - np.outer(self.mean, self.mean)
        self.directions = np.linalg.eigh(spread)[1][:, ::-1][:, :leading]

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates of each row, and the norm of the rest."""
        moved = vectors - self.mean
        lead = moved @ self.directions
        return lead, np.linalg.norm(moved - lead @ self.directions.T, axis=1)


def rotation(vectors: DataFrame, size: int, leading: int) -> Rotation:
    """From the moments of all vectors; a task gives size * (size + 1) + 1 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = np.zeros((size + 1, size + 1))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), rows_of(batch.column("v"), size)])
            moments += x.T @ x
        yield pa.RecordBatch.from_pydict({"place": np.arange(moments.size), "total": moments.ravel()})

    sums = vectors.select("v").mapInArrow(run, "place long, total double").groupBy("place").agg(F.sum("total").alias("total"))
    moments = np.zeros((size + 1) ** 2)
    for r in sums.collect():
        moments[r.place] = r.total
    moments = moments.reshape(size + 1, size + 1)
    return Rotation(moments[0, 0], moments[0, 1:], moments[1:, 1:], leading)


def rotated(vectors: DataFrame, turn: Rotation, size: int) -> DataFrame:
    """Each vector with its leading coordinates and residual norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = turn(rows_of(batch.column("v"), size).astype(np.float64))
            ends = np.arange(len(rest) + 1, dtype=np.int32) * lead.shape[1]
            columns = {"lead": pa.ListArray.from_arrays(ends, lead.ravel()), "rest": pa.array(rest)}
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "v": batch.column("v"), **columns})

    return vectors.mapInArrow(run, "vec_id long, v array<int>, lead array<double>, rest double")


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turn: Rotation) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid's number (the smaller of equals) and the squared distance, in integers."""
    c_lead, c_rest = turn(centroids.astype(np.float64))
    x_norm, c_norm = (lead**2).sum(1), (c_lead**2).sum(1)
    bounds = x_norm[:, None] - 2 * lead @ c_lead.T + c_norm + (rest[:, None] - c_rest) ** 2
    bounds -= ROUNDING * (x_norm[:, None] + rest[:, None] ** 2 + c_norm + c_rest**2 + 1)
    found = bounds.argmin(1)
    best = ((v - centroids[found]) ** 2).sum(1)
    for number, centroid in enumerate(centroids):
        rows = np.flatnonzero((bounds[:, number] <= best) & (found != number))
        distance = ((v[rows] - centroid) ** 2).sum(1)
        closer = (distance < best[rows]) | ((distance == best[rows]) & (number < found[rows]))
        best[rows[closer]], found[rows[closer]] = distance[closer], number
    return found, best


def _placed(batch: pa.RecordBatch, centroids: np.ndarray, turn: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = rows_of(batch.column("v"), centroids.shape[1]).astype(np.int64)
    lead = rows_of(batch.column("lead"), turn.directions.shape[1])
    return v, *nearest(v, lead, batch.column("rest").to_numpy(), centroids, turn)


def moved(vectors: DataFrame, centroids: np.ndarray, turn: Rotation) -> np.ndarray:
    """Each centroid's vectors' mean, rounded down in every component; one without vectors stays."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, size + 1), np.int64)  # the last component counts
        for batch in batches:
            v, found, _ = _placed(batch, centroids, turn)
            order = np.argsort(found, kind="stable")
            v, found = np.column_stack([v, np.ones(len(v), np.int64)])[order], found[order]
            starts = np.flatnonzero(np.diff(found, prepend=-1))
            if len(starts):
                sums[found[starts]] += np.add.reduceat(v, starts, axis=0)
        numbers, places = np.divmod(np.arange(sums.size), size + 1)
        yield pa.RecordBatch.from_pydict({"cluster": numbers, "place": places, "total": sums.ravel()})

    sums = vectors.select("v", "lead", "rest").mapInArrow(run, "cluster long, place long, total long")
    sums = sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals: dict[tuple[int, int], Decimal] = {(r.cluster, r.place): r.total for r in sums.collect()}
    out = centroids.copy()
    for number in range(k):
        if count := int(totals.get((number, size), 0)):
            out[number] = [int(totals[number, j]) // count for j in range(size)]
    return out


def placed(vectors: DataFrame, centroids: np.ndarray, turn: Rotation) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found, best = _placed(batch, centroids, turn)
            columns = {"cluster": pa.array(found, pa.int32()), "distance": pa.array(best, pa.int64())}
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), **columns})

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(
    embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS,
    rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE, leading: int = LEADING,
) -> DataFrame:
    """Per vector its cluster and squared distance, the sums of distances, and its centroid's digest."""
    spark = embeddings.sparkSession
    small_batches(spark)
    vectors = embeddings.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), whole(F.col(f"`{embedding}`"), size, scale).alias("v")
    )
    vectors = written(vectors.where("v is not null"), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").orderBy(name, "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = np.array([r.v for r in first], np.int64)
    turn = rotation(vectors, size, min(leading, size))
    vectors = written(rotated(vectors, turn, size), "rotated")
    for _ in range(rounds):
        centroids = moved(vectors, centroids, turn)
    result = written(placed(vectors, centroids, turn), "clusters")
    sums = result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    every = sum(int(r.s) for r in sums)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # One row a centroid: at most k rows are sent to all tasks.
    about = spark.createDataFrame(
        [(r.cluster, int(r.s), every, digests[r.cluster]) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return result.join(F.broadcast(about), "cluster").select(*[part.split()[0] for part in RESULT.split(", ")])
