"""Applications: lists, guards, scores, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirespan.functions import scoring
from hirespan.functions.text import (
    escaped, normal_skills, packed_skills, packed_texts, unescaped, unpacked_skills, unpacked_texts,
)
from hirespan.operators.percentile import percent_half_up, pools
from hirespan.operators.skew import salted_join, with_value
from hirespan.schemas import ALLOWED

APPLICATION_STATUSES = ALLOWED["applications", "status"]
# What an application list can be sorted by.
SORT_KEYS = ["company", "job_title", "status", "match_score", "applied_at", "deadline"]


def _with_job(rows: DataFrame, job_columns: DataFrame) -> DataFrame:
    """Rows with the columns of their job, if any; Spark splits the join of a job with many rows."""
    return rows.join(job_columns, "job_id", "left")


def resume_name() -> Column:
    label = F.col("label")
    unnamed = label.isNull() | (F.trim(label) == "") | (label == "default")
    return F.when(unnamed, F.col("original_filename")).otherwise(label)


def application_list(
    applications: DataFrame,
    jobs: DataFrame,
    resumes: DataFrame,
    scores: DataFrame | None = None,
    parts: int | None = None,
    floor: int = 0,
) -> DataFrame:
    """Applications with job, resume and, if there is one, score columns.

    The joins go from narrow to wide columns, so that the texts of a job are not shuffled along. Without ``scores``
    applications bear their ``match_score`` and have ids of their own; the finished pool of a job then comes with the
    job, and percentiles as of ``snapshot_percentile`` are looked up there without a join on applications.
    """
    about = jobs.select("job_id", F.col("title").alias("job_title"), "company")
    if scores is not None:
        scored = applications.join(
            scores.select("application_id", "match_score", "percentile", "applicant_count"), "application_id", "left"
        )
    else:
        scored = applications
        about = about.join(pools(applications), "job_id", "left")
    named = scored.join(resumes.select("resume_id", resume_name().alias("resume_name")), "resume_id")
    with_job = salted_join(
        named,
        about,
        ["job_id"],
        ["application_id"],
        parts=parts,
        floor=floor,
        counted=applications,
    )
    if scores is None:
        # What has no id has no score, as in a join on it.
        up_to = F.when(F.col("application_id").isNotNull(), F.try_element_at("pool", F.col("match_score")))
        with_job = with_value(with_job, "n_up_to", up_to).withColumns(
            {
                "match_score": F.when(F.col("n_up_to").isNotNull(), F.col("match_score")),
                "percentile": percent_half_up(F.col("n_up_to"), F.col("n_job")),
                "applicant_count": F.when(F.col("n_up_to").isNotNull(), F.col("n_job")),
            }
        )
    return with_job.select(
        "application_id",
        "user_id",
        "job_id",
        "job_title",
        "company",
        "status",
        F.coalesce("match_score", F.lit(0)).alias("match_score"),
        "percentile",
        F.coalesce("applicant_count", F.lit(0).cast("long")).alias("applicant_count"),
        "applied_at",
        "resume_id",
        "resume_name",
    )


def saved_list(saved: DataFrame, jobs: DataFrame) -> DataFrame:
    columns = ["job_id", "title", "company", "location", "employment_type", "posted_at", "source_url"]
    return saved.join(jobs.select(*columns), "job_id").select("user_id", *columns, "saved_at")


def roast_list(roasts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Roasts with their job, or the stand-in texts of a general one.

    Roasts without a job skip the join, so that nulls do not gather in one task.
    """
    shown = ["roast_id", "user_id", "job_title", "company", "top_dog_rank", "tier_name", "roasted_at"]
    tiered = roasts.withColumn("tier_name", scoring.rank_tier(F.col("top_dog_rank")))
    names = jobs.select("job_id", F.col("title").alias("job_title"), "company")
    general = [F.coalesce("job_title", F.lit("General Roast")).alias("job_title"),
               F.coalesce("company", F.lit("—")).alias("company")]
    with_job = _with_job(tiered.where("job_id is not null"), names)
    without = tiered.where("job_id is null").withColumns(
        {"job_title": F.lit(None).cast("string"), "company": F.lit(None).cast("string")}
    )
    return (
        with_job.unionByName(without)
        .withColumns({"job_title": general[0], "company": general[1]})
        .select(*shown)
    )


def newest_first(rows: DataFrame, owner: str, when: str, key: str) -> DataFrame:
    """Rows of each owner together, newest first.

    The sort key ends with the unique ``key``, so range partitioning cuts large owners too.
    """
    return rows.orderBy(owner, F.col(when).desc(), key)


def sort_by(rows: DataFrame, key: str, descending: bool, tie: str = "application_id") -> DataFrame:
    if key not in SORT_KEYS:
        raise ValueError(f"cannot sort by {key!r}; known keys: {', '.join(SORT_KEYS)}")
    column = F.col(key)
    return rows.orderBy(column.desc() if descending else column.asc(), tie)


def with_position(rows: DataFrame, key: str, descending: bool, owner: str = "user_id", tie: str = "application_id") -> DataFrame:
    """All rows with their ``position`` in their owner's list sorted by ``key``."""
    if key not in SORT_KEYS:
        raise ValueError(f"cannot sort by {key!r}; known keys: {', '.join(SORT_KEYS)}")
    column = F.col(key)
    order = Window.partitionBy(owner).orderBy(column.desc() if descending else column.asc(), tie)
    return rows.withColumn("position", F.row_number().over(order).cast("long"))


def status_condition(wanted: str) -> Column:
    """``ALL``, ``APPLIED`` (scored ones too), or exactly the status."""
    status = F.col("status")
    if wanted == "ALL":
        return F.lit(True)
    return status.isin("APPLIED", "SCORED") if wanted == "APPLIED" else status == wanted


def status_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)`` of requested statuses, upper-cased."""
    upper = changes.withColumn("status", F.upper("status"))
    valid = F.coalesce(F.col("status").isin(APPLICATION_STATUSES), F.lit(False))
    return upper.where(valid), upper.where(~valid).withColumn("reason", F.lit("invalid status"))


def accept_applications(
    requests: DataFrame, existing: DataFrame, jobs: DataFrame, resumes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` requests ``user_id, job_id, resume_id, applied_at``.

    Rules in order: one application per user and job (the first one of a batch stays), the
    job must be there and active, the resume must be there and be the user's.
    """
    keys = ["user_id", "job_id"]
    first = F.min(F.struct("applied_at", "resume_id"))
    batch = requests.groupBy(*keys).agg(first.alias("_first"), F.count(F.lit(1)).alias("_copies"))
    checked = (
        batch.select(*keys, "_first.applied_at", "_first.resume_id", "_copies")
        .join(existing.select(*keys, F.lit(True).alias("_exists")), keys, "left")
        .transform(_with_job, jobs.select("job_id", F.col("status").alias("_job_status")))
        .join(resumes.select("resume_id", F.col("user_id").alias("_owner")), "resume_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("_exists").isNotNull(), "application already exists")
            .when(F.col("_job_status").isNull(), "job not found")
            .when(F.col("_job_status") != "ACTIVE", "job not active")
            .when(F.col("_owner").isNull(), "resume not found")
            .when(F.col("_owner") != F.col("user_id"), "resume belongs to another user"),
        )
    )
    kept = checked.where("reason is null").select(*keys, "resume_id", "applied_at", F.lit("APPLIED").alias("status"))
    rejected = checked.where("reason is not null").select(*keys, "resume_id", "applied_at", "reason")
    return kept, rejected


def new_rows(batch: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch with an unseen key, the first in ``order`` of each key."""
    rest = [c for c in batch.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(0)
    picked = batch.groupBy(*keys).agg(first.alias("_row")).select(*keys, *[f"_row.{c}" for c in rest])
    return picked.join(existing.select(*keys), keys, "left_anti").select(*batch.columns)


def score_applications(
    applications: DataFrame,
    profiles: DataFrame,
    requirements: DataFrame,
    jobs: DataFrame,
    parts: int | None = None,
    floor: int = 0,
    shares: DataFrame | None = None,
) -> DataFrame:
    """Match score and its four parts; null where a profile or requirement list is missing.

    Skill lists are brought to normal form once per resume and job, before the joins; texts of a job are packed for
    the way to the resume. Heavy jobs are counted in the bare applications, and the wider candidate columns come in
    by the last join. ``shares`` is as in ``salted_join``; applications then bear ``_salt`` and may lack an id.
    """
    wanted = jobs.select(
        "job_id", "minimum_years_experience", F.col("education_level").alias("wanted_education")
    ).join(
        requirements.select(
            "job_id",
            packed_skills(scoring.wanted_skills(F.col("required_skills"))).alias("_required"),
            packed_skills(scoring.wanted_skills(F.col("preferred_skills"))).alias("_preferred"),
            F.lit(True).alias("_wanted"),
        ),
        "job_id",
        "left",
    )
    texts = packed_texts(F.col("_required"), F.col("_preferred"), escaped(F.col("wanted_education")))
    wanted = wanted.select("job_id", "minimum_years_experience", "_wanted", texts.alias("_texts"))
    candidate = profiles.select(
        "resume_id",
        normal_skills(F.col("skills")).alias("_skills"),
        "years_experience",
        "education_level",
        F.lit(True).alias("_known"),
    )
    joined = salted_join(
        applications,
        wanted,
        ["job_id"],
        ["application_id"],
        "left",
        parts=parts,
        floor=floor,
        shares=shares,
    ).join(candidate, "resume_id", "left")
    joined = joined.withColumn("_texts", unpacked_texts(F.col("_texts"))).withColumns(
        {
            "_required": unpacked_skills(F.get("_texts", F.lit(0))),
            "_preferred": unpacked_skills(F.get("_texts", F.lit(1))),
            "wanted_education": unescaped(F.get("_texts", F.lit(2))),
        }
    )
    scored = F.col("_known").isNotNull() & F.col("_wanted").isNotNull()
    parts_of_score = joined.withColumn("is_scored", scored).withColumns(
        {
            "required_coverage": F.when(scored, scoring.coverage(F.col("_skills"), F.col("_required"))),
            "preferred_coverage": F.when(scored, scoring.coverage(F.col("_skills"), F.col("_preferred"))),
            "experience_alignment": F.when(
                scored, scoring.experience_alignment(F.col("years_experience"), F.col("minimum_years_experience"))
            ),
            "education_alignment": F.when(
                scored, scoring.education_alignment(F.col("education_level"), F.col("wanted_education"))
            ),
        }
    )
    names = ["required_coverage", "preferred_coverage", "experience_alignment", "education_alignment"]
    score = scoring.match_score(*[F.col(name) for name in names])
    return parts_of_score.select(
        *[c for c in applications.columns if c != "_salt"], "is_scored", *names, F.when(F.col("is_scored"), score).alias("match_score")
    )


def with_scored_status(scored: DataFrame) -> DataFrame:
    """Scored applications as they are kept: SCORED where a score was worked out, else APPLIED."""
    return scored.withColumn("status", F.when(F.col("is_scored"), "SCORED").otherwise("APPLIED"))


def scores_of_jobs(scores: DataFrame, applications: DataFrame, wanted: DataFrame) -> DataFrame:
    """Scores whose application is for one of the wanted jobs."""
    chosen = applications.join(wanted.select("job_id").distinct(), "job_id", "left_semi")
    return scores.join(chosen.select("application_id"), "application_id", "left_semi")


def funnel(applications: DataFrame) -> DataFrame:
    """Per user: applications, interviews, offers, rejections, and the interview rate in percent."""
    status = F.col("status")
    counted = applications.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "INTERVIEWING").alias("interviewing"),
        F.count_if(status == "OFFER").alias("offers"),
        F.count_if(status == "REJECTED").alias("rejected"),
    )
    rate = F.floor(F.col("interviewing") / F.col("total") * 100.0 + 0.5).cast("int")
    return counted.withColumn("interview_rate", rate)


def mean_scores(applications: DataFrame) -> DataFrame:
    """Per user: rounded mean match score of the applications given."""
    return applications.groupBy("user_id").agg(
        scoring.round_half_up(F.avg(F.coalesce("match_score", F.lit(0)))).alias("mean_score")
    )
