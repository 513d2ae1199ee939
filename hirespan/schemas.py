"""Columns, keys and allowed values of the job-market tables.

Text lengths and allowed values are rules about rows: ``violations`` finds rows which break them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BASE = ", created_at timestamp, updated_at timestamp"

TABLES = {
    "users": "user_id string, email string, display_name string, role string, profile_visibility string" + BASE,
    "resumes": (
        "resume_id string, user_id string, label string, storage_key string, original_filename string, content_type string, "
        "file_size_bytes bigint, checksum_sha256 string, status string, uploaded_at timestamp" + BASE
    ),
    "resume_profiles": "resume_id string, skills array<string>, years_experience int, education_level string" + BASE,
    "jobs": (
        "job_id string, source string, source_job_id string, source_url string, title string, company string, location string, "
        "employment_type string, description_text string, description_hash string, status string, "
        "minimum_years_experience int, education_level string, posted_at timestamp, scraped_at timestamp" + BASE
    ),
    "job_requirement_profiles": (
        "job_id string, required_skills array<string>, preferred_skills array<string>, extraction_method string" + BASE
    ),
    "applications": (
        "application_id string, user_id string, job_id string, resume_id string, status string, applied_at timestamp" + BASE
    ),
    "application_scores": (
        "application_id string, match_score int, match_breakdown struct<required_coverage:double,preferred_coverage:double,"
        "experience_alignment:double,education_alignment:double>, benchmark_state string, percentile int, "
        "applicant_count int, scored_at timestamp" + BASE
    ),
    "saved_jobs": "user_id string, job_id string, saved_at timestamp" + BASE,
    "ghost_reports": "user_id string, company string, job_id string, reported_at timestamp" + BASE,
    "roast_history": (
        "user_id string, resume_id string, job_id string, roast_text string, missing_dependencies array<string>, "
        "top_dog_rank int, tier_name string, roasted_at timestamp" + BASE
    ),
    "resume_analyses": (
        "resume_id string, user_level string, target_role string, overall_score int, ats_score int, ats_issues array<string>, "
        "section_scores map<string,int>, bullet_feedback array<struct<original:string,score:int,issue:string,improved:string>>, "
        "strengths array<string>, improvements array<string>, summary_verdict string, ats_parsed_sections map<string,struct<text:string,items:array<string>>>, "
        "recruiter_take array<struct<section:string,grade:string,comment:string,red_flags:array<string>>>, "
        "analyzed_at timestamp" + BASE
    ),
    "resume_job_fits": (
        "resume_id string, job_id string, fit_score int, matched_skills array<string>, missing_skills array<string>, "
        "fit_summary string, analyzed_at timestamp" + BASE
    ),
    "benchmark_jobs": "title string, company string, category string, difficulty_level int, description string",
}

KEYS = {
    "users": ["email"],
    "resumes": ["storage_key"],
    "resume_profiles": ["resume_id"],
    "jobs": ["source_url"],
    "job_requirement_profiles": ["job_id"],
    "applications": ["user_id", "job_id"],
    "application_scores": ["application_id"],
    "saved_jobs": ["user_id", "job_id"],
    "resume_job_fits": ["resume_id", "job_id"],
}

# What status-like columns may hold.
ALLOWED = {
    ("jobs", "status"): ["SCRAPED", "NORMALIZED", "ACTIVE", "CLOSED"],
    ("resumes", "status"): ["UPLOADED", "PROCESSING", "PARSED", "FAILED"],
    ("applications", "status"): [
        "APPLIED", "SCORED", "INTERVIEWING", "OFFER", "REJECTED", "WITHDRAWN", "RUNNING", "ORPHANED", "KILLED", "FAILED",
    ],
    ("application_scores", "benchmark_state"): ["EARLY_APPLICANT", "PERCENTILE_READY"],
    ("users", "profile_visibility"): ["PRIVATE", "PUBLIC"],
}

# Longest text of a column; columns which may not be null.
LONGEST = {
    ("users", "email"): 320,
    ("users", "display_name"): 120,
    ("resumes", "label"): 120,
    ("resumes", "storage_key"): 512,
    ("resumes", "original_filename"): 255,
    ("jobs", "source"): 64,
    ("jobs", "source_job_id"): 255,
    ("jobs", "title"): 255,
    ("jobs", "company"): 255,
    ("jobs", "location"): 255,
    ("ghost_reports", "company"): 255,
    ("resume_analyses", "target_role"): 120,
}
NEEDED = {
    "users": ["email", "display_name"],
    "resumes": ["user_id", "storage_key", "original_filename", "content_type", "status", "uploaded_at"],
    "jobs": ["source", "source_url", "title", "company", "description_text", "description_hash", "status", "scraped_at"],
    "applications": ["user_id", "job_id", "resume_id", "status", "applied_at"],
    "application_scores": ["application_id", "match_score", "benchmark_state", "applicant_count", "scored_at"],
    "saved_jobs": ["user_id", "job_id", "saved_at"],
    "ghost_reports": ["user_id", "company", "reported_at"],
}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def violations(frame: DataFrame, table: str) -> DataFrame:
    """Rows which break a rule of the table, with the reasons as an array."""
    found: list[Column] = []
    for name in NEEDED.get(table, []):
        found.append(F.when(F.col(name).isNull(), f"{name} is missing"))
    for (owner, name), limit in LONGEST.items():
        if owner == table:
            found.append(F.when(F.length(name) > limit, f"{name} is too long"))
    for (owner, name), values in ALLOWED.items():
        if owner == table:
            found.append(F.when(~F.col(name).isin(values), f"{name} is not allowed"))
    return frame.withColumn("reasons", F.array_compact(F.array(*found))).where(F.size("reasons") > 0)


def repeated_keys(frame: DataFrame, table: str) -> DataFrame:
    """Keys which occur more than once; keys with a null part are not compared."""
    keys = KEYS[table]
    known = reduce(lambda left, right: left & right, [F.col(key).isNotNull() for key in keys])
    return frame.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
