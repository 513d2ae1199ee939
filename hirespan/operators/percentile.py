"""Applicant counts and percentiles, as of arrival and over the finished pool.

Input ``scores``: ``application_id, job_id, match_score (0..100), scored_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirespan.operators.skew import with_order_slices

# Applicants needed before a percentile is shown; percentile of an empty pool.
FIRST_RANKED_APPLICANT = 5
EMPTY_POOL_PERCENTILE = 50

# A score 0..100 is read as two digits of base 11, so that a running "scores up to mine"
# needs 10 + 11 running counts and not 101.
BASE = 11


def percent_half_up(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded half up, in whole numbers; null for an empty whole."""
    return F.floor((part * 200 + whole) / F.nullif(whole * 2, F.lit(0))).cast("int")


def scored_applicants(scores: DataFrame) -> DataFrame:
    """Scored applicants per job."""
    return scores.groupBy("job_id").agg(F.count(F.lit(1)).alias("applicant_count"))


def percentile_of(scores: DataFrame, probes: DataFrame) -> DataFrame:
    """Percentile of given ``(job_id, probe_score)`` rows; a job without scores gives 50."""
    pool = _cumulative(scores)
    # One row per (job, score) on both sides: a job has at most 101 of them.
    joined = probes.join(pool.withColumnRenamed("match_score", "pool_score"), "job_id", "left")
    return (
        joined.groupBy("job_id", "probe_score")
        .agg(
            F.max(F.when(F.col("pool_score") <= F.col("probe_score"), F.col("n_up_to"))).alias("below"),
            F.max("n_job").alias("pool"),
        )
        .select(
            "job_id",
            "probe_score",
            F.coalesce(
                percent_half_up(F.coalesce("below", F.lit(0).cast("long")), F.col("pool")),
                F.lit(EMPTY_POOL_PERCENTILE),
            ).alias("percentile"),
        )
    )


def _cumulative(scores: DataFrame) -> DataFrame:
    """Per (job, score): rows up to that score and rows of the job. At most 101 rows per job."""
    by_job = Window.partitionBy("job_id")
    return (
        scores.groupBy("job_id", "match_score")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("n_up_to", F.sum("n").over(by_job.orderBy("match_score")))
        .withColumn("n_job", F.sum("n").over(by_job))
        .drop("n")
    )


def _with_pool(scores: DataFrame) -> DataFrame:
    """Scores with ``n_up_to`` and ``n_job``, joined from the counts per (job, score).

    A heavy (job, score) pair meets a single row, so the join is left to Spark's own splitting of skewed joins.
    """
    return scores.join(_cumulative(scores), ["job_id", "match_score"])


def pools(scores: DataFrame) -> DataFrame:
    """Per job: ``pool``, the rows up to each of its scores (at most 101 entries), and ``n_job``, its rows."""
    entry = F.struct("match_score", "n_up_to")
    known = F.col("match_score").isNotNull()
    return (
        _cumulative(scores)
        .groupBy("job_id")
        .agg(F.map_from_entries(F.collect_list(F.when(known, entry))).alias("pool"), F.max("n_job").alias("n_job"))
    )


def snapshot_percentile(scores: DataFrame) -> DataFrame:
    """Share of the job's finished pool with a score up to one's own, own row included."""
    return _with_pool(scores).select(
        "application_id",
        "job_id",
        "match_score",
        (F.col("n_up_to") / F.col("n_job")).alias("cume_dist"),
        percent_half_up(F.col("n_up_to"), F.col("n_job")).alias("percentile"),
        F.col("n_job").alias("applicant_count"),
    )


def arrival_percentile(
    scores: DataFrame, parts: int | None = None, floor: int = 0, keep_counts: bool = False, tie: str = "application_id"
) -> DataFrame:
    """What each applicant was told on arrival.

    ``applicant_count`` counts the applicant and all earlier ones; the percentile compares with
    earlier ones only and is null for the first four. Heavy jobs are cut into time slices; the
    counts of earlier slices come from a table of at most 101 rows per slice. ``keep_counts``
    gives the bare counts ``_n`` (earlier rows) and ``_le`` (those with a score up to one's own). ``tie``
    orders the rows of a job that have the same time.
    """
    order = ["scored_at", tie]
    sliced = with_order_slices(scores, "job_id", order, parts, floor)
    group = ["job_id", "slice"]
    # The digits are worked out where the rows are counted and not moved along.
    rows = (
        sliced.drop("is_sliced")
        .repartition(*group)
        .withColumn("_high", F.floor(F.col("match_score") / BASE).cast("int"))
        .withColumn("_low", F.pmod("match_score", F.lit(BASE)))
    )
    earlier = (
        Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier_same_high = (
        Window.partitionBy(*group, "_high")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    highs = F.array(*[F.count_if(F.col("_high") < digit).over(earlier) for digit in range(10)])
    lows = F.array(*[F.count_if(F.col("_low") <= digit).over(earlier_same_high) for digit in range(BASE)])
    counted = rows.select(
        *scores.columns,
        "slice",
        F.count(F.lit(1)).over(earlier).alias("_n_in_slice"),
        (F.get(highs, F.col("_high")) + F.get(lows, F.col("_low"))).alias("_le_in_slice"),
    )
    zero = F.lit(0).cast("long")
    # Small whatever the data (see there), so the rows stay where the counting put them.
    full = counted.join(F.broadcast(_before_slice(sliced)), ["job_id", "slice", "match_score"], "left").select(
        *scores.columns,
        (F.col("_n_in_slice") + F.coalesce("_n_before", zero)).alias("_n"),
        (F.col("_le_in_slice") + F.coalesce("_le_before", zero)).alias("_le"),
    )
    return full if keep_counts else with_arrival_state(full, scores.columns)


def with_arrival_state(counted: DataFrame, columns: list[str]) -> DataFrame:
    """Applicant number, state and percentile from the earlier rows ``_n`` and those up to the score ``_le``."""
    ready = F.col("_n") + 1 >= FIRST_RANKED_APPLICANT
    return counted.select(
        *columns,
        (F.col("_n") + 1).alias("applicant_count"),
        F.when(ready, F.lit("PERCENTILE_READY")).otherwise("EARLY_APPLICANT").alias("benchmark_state"),
        F.when(ready, percent_half_up(F.col("_le"), F.col("_n"))).alias("percentile"),
    )


def _before_slice(rows: DataFrame) -> DataFrame:
    """For sliced jobs: per (job, slice, score) the earlier slices' rows, and those up to the score.

    At most 101 rows per slice and twice ``parts`` slices, whatever the data.
    """
    sizes = (
        rows.where("is_sliced")
        .groupBy("job_id", "slice", "match_score")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = (
        sizes.select("job_id", "slice")
        .distinct()
        .withColumn("match_score", F.explode(F.sequence(F.lit(0), F.lit(100))))
    )
    in_slice = Window.partitionBy("job_id", "slice").orderBy("match_score")
    before = (
        Window.partitionBy("job_id", "match_score")
        .orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        grid.join(sizes, ["job_id", "slice", "match_score"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        .withColumn("_le", F.sum("n").over(in_slice))
        .withColumn("_all", F.sum("n").over(Window.partitionBy("job_id", "slice")))
        .select(
            "job_id",
            "slice",
            "match_score",
            F.sum("_le").over(before).alias("_le_before"),
            F.sum("_all").over(before).alias("_n_before"),
        )
    )


def leaderboard(scores: DataFrame) -> DataFrame:
    """Rank within the job by score, best first; equal scores share a rank.

    The rank is one plus the rows with a higher score, so it comes from the score counts.
    """
    return _with_pool(scores).select(
        "job_id",
        "application_id",
        "match_score",
        (F.col("n_job") - F.col("n_up_to") + 1).alias("position"),
    )
