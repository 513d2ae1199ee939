"""Clusters against plain integer arithmetic over all centroids."""

import hashlib
import math
import random

import numpy as np
import pytest

from hirespan.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds=5):
    kept = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows
            if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    middle = [v for _, v in named[:k]]

    def placed():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle)) for _, v in kept]

    for _ in range(rounds):
        at = [n for _, n in placed()]
        for n in range(len(middle)):
            own = [v for (_, v), m in zip(kept, at, strict=True) if m == n]
            if own:
                middle[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    ends = placed()
    total = sum(d for d, _ in ends)
    inner = {n: sum(d for d, m in ends if m == n) for _, n in ends}
    digest = {n: hashlib.sha256(",".join(map(str, middle[n])).encode()).hexdigest() for _, n in ends}
    return sorted(((i, n, d, inner[n], total, digest[n]) for (i, _), (d, n) in zip(kept, ends, strict=True)), key=repr)


def vectors(seed, n):
    """Rounded to float, so that both sides see one number."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [np.float32([m + rng.gauss(0, 0.2) for m in rng.choice(middles)]).astype(float).tolist() for _ in range(n)]


@pytest.mark.parametrize("k, leading", [(40, 12), (7, 1), (12, 64)])
def test_against_all_distances(spark, k, leading):
    rows = list(enumerate(vectors(k, 150)))
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # a group of copies
    rows += [(3, rows[5][1]), (3, rows[5][1]), (None, rows[9][1]), (300, [0.0] * 64), (301, [-0.001] * 64)]
    awkward = [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [None] + [1.0] * 63),
               (405, [float("nan")] + [1.0] * 63), (406, [float("-inf")] + [1.0] * 63)]
    frame = spark.createDataFrame([(i, e, 0) for i, e in rows + awkward], SCHEMA).withColumnRenamed("label", "cluster")
    found = centroids.clustered(frame, k=k, leading=leading).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows, k)


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [0.5] * 64) for i in range(5)]
    found = centroids.clustered(spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)).collect()
    assert sorted(map(tuple, found)) == brute(rows, 40)
    assert {r.cluster for r in found} == {0}
    assert centroids.clustered(spark.createDataFrame([], SCHEMA)).collect() == []


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(spark.createDataFrame([(1, [3e38] * 64, 0)], SCHEMA)).collect()


def test_bounds_rule_out_no_centroid():
    rng = np.random.default_rng(3)
    v = rng.integers(-4000, 4000, (300, 64))
    middle = np.concatenate([v[:30], v[:3], rng.integers(-4000, 4000, (9, 64))])
    x = v.astype(float)
    for leading in (1, 12, 63):
        turn = centroids.Rotation(len(x), x.sum(0), x.T @ x, leading)
        at, distance = centroids.nearest(v, *turn(x), middle, turn)
        every = ((v[:, None] - middle[None]) ** 2).sum(2)
        assert (distance == every.min(1)).all() and (at == every.argmin(1)).all()
