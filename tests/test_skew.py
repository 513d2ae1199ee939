"""Splitting heavy keys must not change a single row."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from hirespan.operators import skew
from hirespan.operators.percentile import arrival_percentile, leaderboard, snapshot_percentile


@pytest.fixture(scope="module")
def scores(spark):
    """One job holds over a third of all rows, many of them at the same moment."""
    draw = random.Random(7)
    rows = []
    for number in range(3000):
        job = 1 if number % 5 < 2 else draw.randrange(2, 60)
        day = draw.choice([1, 1, 1, 2, 3, 4, 5, 6])
        rows.append((number, job, draw.choice([0, 10, 10, 55, 99, 100, draw.randrange(101)]), f"2024-01-0{day} 00:00:00"))
    frame = spark.createDataFrame(rows, "application_id long, job_id long, match_score int, at string")
    return frame.withColumn("scored_at", F.col("at").cast("timestamp")).drop("at").cache()


def replay(rows):
    """One application after the other, as each user saw it."""
    told, seen = {}, {}
    for row in sorted(rows, key=lambda r: (r.job_id, r.scored_at, r.application_id)):
        before = seen.setdefault(row.job_id, [])
        rank = len(before) + 1
        if rank < 5:
            told[row.application_id] = (rank, "EARLY_APPLICANT", None)
        else:
            le = bisect.bisect_right(before, row.match_score)
            told[row.application_id] = (rank, "PERCENTILE_READY", int(100 * le / len(before) + 0.5))
        bisect.insort(before, row.match_score)
    return told


@pytest.mark.parametrize("options", [{}, {"parts": 16, "floor": 50}, {"parts": 64, "floor": 1}])
def test_arrival_percentile_equals_replay(scores, options):
    expected = replay(scores.collect())
    found = {r.application_id: (r.applicant_count, r.benchmark_state, r.percentile) for r in arrival_percentile(scores, **options).collect()}
    assert found == expected


def test_heavy_job_is_cut_into_slices_of_bounded_size(scores):
    sliced = skew.with_order_slices(scores, "job_id", ["scored_at", "application_id"], parts=16, floor=50)
    sizes = {(r.job_id, r.slice): r["count"] for r in sliced.groupBy("job_id", "slice").count().collect()}
    hot = [n for (job, _), n in sizes.items() if job == 1]
    assert len(hot) >= 4 and max(hot) < 3 * 3000 / 16
    assert all(part == 0 for (job, part) in sizes if job != 1)


def test_slices_follow_the_order(scores):
    rows = skew.with_order_slices(scores, "job_id", ["scored_at", "application_id"], parts=16, floor=50).where("job_id = 1").collect()
    ordered = sorted(rows, key=lambda r: (r.scored_at, r.application_id))
    assert [r.slice for r in ordered] == sorted(r.slice for r in ordered)


def test_default_arguments_cut_the_heavy_job(scores):
    sliced = skew.with_order_slices(scores, "job_id", ["scored_at", "application_id"])
    assert sliced.where("job_id = 1").select("slice").distinct().count() >= 2


def test_counts_give_positions_and_shares(scores):
    rows = scores.collect()
    pools = {}
    for row in rows:
        pools.setdefault(row.job_id, []).append(row.match_score)
    shares = {r.application_id: r.cume_dist for r in snapshot_percentile(scores).collect()}
    places = {r.application_id: r.position for r in leaderboard(scores).collect()}
    for row in rows:
        pool = pools[row.job_id]
        assert shares[row.application_id] == sum(s <= row.match_score for s in pool) / len(pool)
        assert places[row.application_id] == 1 + sum(s > row.match_score for s in pool)


def test_salted_left_join_keeps_unmatched_rows(spark, scores):
    names = spark.createDataFrame([(1, "hot"), (2, "two")], "job_id long, name string")
    plain = sorted(map(str, scores.join(names, ["job_id"], "left").select("application_id", "name").collect()))
    salted = skew.salted_join(scores, names, ["job_id"], ["application_id"], "left", parts=16, floor=50)
    assert sorted(map(str, salted.select("application_id", "name").collect())) == plain
    shares = skew.heavy_keys(scores, ["job_id"], 16, 50).collect()
    assert [r.job_id for r in shares] == [1]


def test_position_in_counts_smaller_bounds(spark):
    bounds = F.array(*[F.lit(b) for b in (2, 4, 4, 9)])
    row = spark.range(1).select(*[skew.position_in(bounds, F.lit(k)).alias(f"k{k}") for k in (1, 2, 3, 4, 5, 9, 10)]).first()
    assert list(row) == [0, 0, 1, 1, 3, 3, 4]
    empty = F.array().cast("array<int>")
    assert spark.range(1).select(skew.position_in(empty, F.lit(3))).first()[0] == 0


def test_too_many_parts_are_refused(scores):
    with pytest.raises(ValueError, match="at most"):
        skew.checked_parts(scores, skew.MOST_PARTS + 1)
