"""How responsive companies are: reports, days open, and the ghost score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirespan.functions.ages import whole_days
from hirespan.functions.scoring import ghost_risk, ghost_score


def company_key() -> Column:
    return F.lower("company").alias("company_key")


def reports_per_company(reports: DataFrame) -> DataFrame:
    return reports.groupBy(company_key()).agg(F.count(F.lit(1)).alias("ghost_reports"))


def days_open(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs and mean whole days since posting per company, whatever the job's status."""
    days = F.avg(whole_days(F.col("posted_at"), as_of))
    return jobs.groupBy(company_key()).agg(
        F.count(F.lit(1)).alias("total_jobs"), F.coalesce(days, F.lit(0.0)).alias("avg_days")
    )


def ghost_scores(jobs: DataFrame, reports: DataFrame, as_of: Column) -> DataFrame:
    """Score and risk of every company that has a job or a report.

    Both sides are grouped first, so the join sees one row per company and no hot key.
    """
    zero = F.lit(0).cast("long")
    joined = (
        days_open(jobs, as_of)
        .join(reports_per_company(reports), "company_key", "full_outer")
        .select(
            "company_key",
            F.coalesce("avg_days", F.lit(0.0)).alias("avg_days"),
            F.coalesce("ghost_reports", zero).alias("ghost_reports"),
            F.coalesce("total_jobs", zero).alias("total_jobs"),
        )
    )
    scored = joined.withColumn(
        "ghost_score", ghost_score(F.col("avg_days"), F.col("ghost_reports"), F.col("total_jobs"))
    )
    return scored.select(
        "company_key",
        "ghost_score",
        F.floor(F.col("avg_days") + 0.5).cast("long").alias("avg_days_open"),
        "ghost_reports",
        "total_jobs",
        ghost_risk(F.col("ghost_score")).alias("risk"),
    )
