"""Latest or best row per owner, guards, and public profiles.

"First row of each group" is an aggregate over (sort keys, row): Spark combines it before
the shuffle, so a group of any size reaches the network as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greatest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in ``order``, compared left to right.

    ``order`` should end with a unique column so that the choice is fixed.
    """
    ordered = [F.col(name) for name in order]
    rest = [F.col(name) for name in rows.columns if name not in {*keys, *order}]
    best = F.max(F.struct(F.struct(*ordered).alias("o"), F.struct(*rest, F.lit(0).alias("_")).alias("r")))
    # Struct columns outside the order only break ties of equal order columns.
    picked = rows.groupBy(*keys).agg(best.alias("best"))
    return picked.select(
        *keys,
        *[F.col(f"best.o.{name}").alias(name) for name in order],
        *[F.col(f"best.r.{c}").alias(c) for c in rows.columns if c not in {*keys, *order}],
    ).select(*rows.columns)


def latest_profiles(profiles: DataFrame, resumes: DataFrame) -> DataFrame:
    """Each user's profile of the newest resume that has one."""
    joined = profiles.join(resumes.select("resume_id", "user_id", "uploaded_at"), "resume_id")
    return greatest_per_key(joined, ["user_id"], ["uploaded_at", "resume_id"])


def latest_analyses(analyses: DataFrame) -> DataFrame:
    return greatest_per_key(analyses, ["resume_id"], ["analyzed_at", "analysis_id"])


def best_analyses(analyses: DataFrame) -> DataFrame:
    """Each user's best analysis: highest score, then newest."""
    return greatest_per_key(analyses, ["user_id"], ["overall_score", "analyzed_at", "analysis_id"])


def public_profiles(users: DataFrame, best: DataFrame, only_public: bool = True) -> DataFrame:
    """Public users with their best analysis, if any; ``only_public=False`` shows all users."""
    shown = users.where(F.col("profile_visibility") == "PUBLIC") if only_public else users
    return shown.select("user_id", "display_name").join(best, "user_id", "left")


def owned(children: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejected)``: children whose ``user_id`` owns the parent row, and all others."""
    owners = parents.select(key, F.col("user_id").alias("_owner"))
    joined = children.join(owners, key, "left")
    mine = F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False))
    reason = F.when(F.col("_owner").isNull(), f"{key} not found").otherwise("belongs to another user")
    return (
        joined.where(mine).drop("_owner"),
        joined.where(~mine).withColumn("reason", reason).drop("_owner"),
    )


def ready_for_analysis(resumes: DataFrame) -> DataFrame:
    return resumes.where(F.col("status") == "PARSED")


def fits_to_compute(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested (resume, job) pairs, once each, for which no fit is stored."""
    keys = ["resume_id", "job_id"]
    return requests.select(*keys).distinct().join(stored.select(*keys), keys, "left_anti")
