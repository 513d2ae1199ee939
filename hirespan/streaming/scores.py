"""Scoring applications as they arrive, in whatever order and number of batches.

What an applicant is told depends on all who applied before. Two things are kept: scored applications in
slices of time, and for each job how many applications have each score, at most 101 counts. A batch needs, for
each of its jobs, the slices from its own earliest application on; what lies before is the job's counts less
what these slices hold. If all of a batch is new in time, that is the present slice. If an application comes
late, those after it in its job are told anew, and all slices since are read for that job, and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirespan.operators.applications import score_applications
from hirespan.operators.percentile import arrival_percentile, with_arrival_state
from hirespan.sources.buckets import Buckets
from hirespan.sources.store import drop_versions, exists, write_version

# Applications of a day are one slice.
SLICE = "yyyy-MM-dd"
FRESH = ["application_id", "user_id", "job_id", "match_score", "scored_at"]


def score_batch(
    path: str, profiles: DataFrame, requirements: DataFrame, jobs: DataFrame, slices: str = SLICE, buckets: int = 16
):
    """A batch handler: score new applications, rank them, and rank anew those that they come before.

    ``path/ranked`` holds what each batch told; ``told`` gives the present state of all.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        scored = score_applications(batch, profiles, requirements, jobs).where("is_scored")
        fresh = scored.withColumn("scored_at", F.col("applied_at")).select(*FRESH)
        totals = Buckets(f"{path}/totals", ["job_id"], fresh.select("job_id", "match_score").schema.add("n", "long"), buckets)
        if totals.staged(spark, number) is None:
            fresh = fresh.withColumns({"slice": F.date_format("scored_at", slices), "batch": F.lit(number).cast("long")})
            writer = fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("slice", "batch").parquet(f"{path}/scored")
            rank(spark, totals, number, fresh.drop("slice", "batch").schema)
        totals.put(spark, number)

    def rank(spark: SparkSession, totals: Buckets, number: int, schema) -> None:
        stored = spark.read.schema(schema.add("slice", "string").add("batch", "long")).parquet(f"{path}/scored")
        fresh = stored.where(F.col("batch") == number)
        since = fresh.groupBy("job_id").agg(F.min("scored_at").alias("since"), F.min("slice").alias("from_slice"))
        earliest = since.agg(F.min("from_slice")).first()[0]
        if earliest is None:
            totals.stage(spark.createDataFrame([], totals.schema), number)
            return
        later = stored.where((F.col("slice") >= earliest) & (F.col("batch") <= number))
        later = later.join(since, "job_id").where("slice >= from_slice").select(*FRESH, "batch", "since")
        # Counted, cut into slices and ranked: written once, and gone when that is done.
        write_version(later, f"{path}/later", number)
        later = spark.read.schema(later.schema).parquet(f"{path}/later/v={number:012d}")
        before = totals.met_by(since)
        earlier = later.where(F.col("batch") < number).groupBy("job_id", "match_score").agg(F.count(F.lit(1)).alias("seen"))
        counts = before.join(earlier, ["job_id", "match_score"], "left").select(
            "job_id", "match_score", (F.col("n") - F.coalesce("seen", F.lit(0))).alias("n")
        )
        ranked = rank_among(later.select(*FRESH, "since"), counts).where("scored_at >= since").drop("since")
        write_version(ranked.withColumn("told_by", F.lit(number).cast("long")), f"{path}/ranked", number)
        added = fresh.groupBy("job_id", "match_score").agg(F.count(F.lit(1)).alias("n"))
        totals.stage(before.unionByName(added).groupBy("job_id", "match_score").agg(F.sum("n").alias("n")), number)
        drop_versions(spark, f"{path}/later", before=number + 1)

    return handle


def told(spark: SparkSession, path: str) -> DataFrame | None:
    """What every applicant was told last."""
    if not exists(spark, f"{path}/ranked"):
        return None
    ranked = spark.read.parquet(f"{path}/ranked").drop("v")
    rest = [c for c in ranked.columns if c not in ("application_id", "told_by")]
    last = ranked.groupBy("application_id").agg(F.max_by(F.struct(*rest), "told_by").alias("_row"))
    return last.select("application_id", *[F.col(f"_row.{c}").alias(c) for c in rest])


def rank_among(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Arrival rank and percentile of ``rows``, given the score counts of all before them."""
    # Among themselves, counted like the whole-table form; the counts of before are added.
    inside = arrival_percentile(rows, keep_counts=True)
    wanted = rows.select("job_id", "match_score").distinct()
    older = (
        wanted.join(counts.withColumnRenamed("match_score", "_score"), "job_id")
        .groupBy("job_id", "match_score")
        .agg(
            F.sum("n").alias("_older"),
            F.sum(F.when(F.col("_score") <= F.col("match_score"), F.col("n"))).alias("_older_le"),
        )
    )
    zero = F.lit(0).cast("long")
    joined = (
        inside.join(older, ["job_id", "match_score"], "left")
        .withColumn("_n", F.col("_n") + F.coalesce("_older", zero))
        .withColumn("_le", F.col("_le") + F.coalesce("_older_le", zero))
    )
    return with_arrival_state(joined, rows.columns)
