"""Postings from the JSON of job boards.

Input ``landing``: ``company, token, body`` with one response per row. Each parser gives
``(postings, rejects)``; a response that cannot be read is rejected as a whole. If ``landing`` has
``fetched_at``, postings carry it together with their ``position`` in the response.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirespan.functions.text import content_hash, is_internship, is_internship_posting, strip_tags
from hirespan.sources.listings import ARRIVAL, JOB_FIELDS, carried

BOARD_SCHEMA = (
    "jobs array<struct<id bigint, title string, location struct<name string>, absolute_url string, "
    "updated_at timestamp, departments array<struct<name string>>, content string>>"
)
POSTINGS_SCHEMA = (
    "array<struct<id string, text string, descriptionPlain string, additional string, hostedUrl string, "
    "categories struct<location string, commitment string>, createdAt bigint, "
    "salaryRange struct<min double, max double, currency string, interval string>>>"
)
LIST_SCHEMA = (
    "total int, jobPostings array<struct<title string, externalUrl string, "
    "locations array<struct<city string, country string>>, postedOn string>>"
)
DETAIL_SCHEMA = "jobReqId string, title string, jobDescription string, postedOn string, location string"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _read(landing: DataFrame, schema: str, root: str | None) -> tuple[DataFrame, DataFrame]:
    """Split responses into read ones (column ``_r``) and rejects."""
    readable = F.try_parse_json(F.col("body")).isNotNull()
    parsed = landing.where(readable).withColumn("_r", F.from_json("body", schema))
    if root:
        parsed = parsed.withColumn("_r", F.col(f"_r.{root}"))
    bad = landing.where(~F.coalesce(readable, F.lit(False)))
    return parsed.drop("body"), bad.withColumn("reason", F.lit("unreadable response"))


def _day(text: Column) -> Column:
    """A ``yyyy-MM-dd`` date; anything else is unknown."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))


def parse_board(landing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boards of ``{jobs: [...]}``; internships only."""
    read, bad = _read(landing, BOARD_SCHEMA, "jobs")
    jobs = read.select("company", "token", *carried(landing), F.posexplode("_r").alias("position", "j")).where(is_internship(F.col("j.title")))
    return jobs.select(
        *carried(jobs),
        F.lit("greenhouse").alias("source"),
        F.concat(F.lit("gh-"), "token", F.lit("-"), F.col("j.id").cast("string")).alias("source_job_id"),
        F.col("j.absolute_url").alias("source_url"),
        F.col("j.title").alias("title"),
        "company",
        _text("j.location.name").alias("location"),
        F.lit("INTERNSHIP").alias("employment_type"),
        strip_tags(_text("j.content")).alias("description_text"),
        F.lit("ACTIVE").alias("status"),
        F.col("j.updated_at").alias("posted_at"),
    ), bad


def parse_postings(landing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arrays of postings; internships by title or commitment. Salary is added to the text."""
    read, bad = _read(landing, POSTINGS_SCHEMA, None)
    jobs = read.select("company", "token", *carried(landing), F.posexplode("_r").alias("position", "j")).where(
        is_internship_posting(_text("j.text"), F.col("j.categories.commitment"))
    )
    extra = F.when(
        _text("j.additional") != "", F.concat(F.lit("\n\n"), strip_tags(F.col("j.additional")))
    ).otherwise("")
    # Amounts are rounded half to even.
    low, high = (F.bround(F.coalesce(F.col(f"j.salaryRange.{end}"), F.lit(0.0)), 0) for end in ("min", "max"))
    salary = F.when(
        F.col("j.salaryRange").isNotNull(),
        F.format_string(
            "\n\nSalary: %s %.0f-%.0f/%s", _text("j.salaryRange.currency"), low, high, _text("j.salaryRange.interval")
        ),
    ).otherwise("")
    return jobs.select(
        *carried(jobs),
        F.lit("lever").alias("source"),
        F.concat(F.lit("lever-"), "token", F.lit("-"), "j.id").alias("source_job_id"),
        F.col("j.hostedUrl").alias("source_url"),
        F.col("j.text").alias("title"),
        "company",
        _text("j.categories.location").alias("location"),
        F.lit("INTERNSHIP").alias("employment_type"),
        F.concat(_text("j.descriptionPlain"), extra, salary).alias("description_text"),
        F.lit("ACTIVE").alias("status"),
        F.timestamp_millis(F.coalesce("j.createdAt", F.lit(0).cast("long"))).alias("posted_at"),
    ), bad


def parse_list(landing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Search lists: first location only, no source key, a generated text."""
    read, bad = _read(landing, LIST_SCHEMA, "jobPostings")
    jobs = read.select("company", *carried(landing), F.posexplode("_r").alias("position", "j"))
    place = F.get("j.locations", F.lit(0))
    located = F.concat(
        F.coalesce(place["city"], F.lit("")), F.lit(", "), F.coalesce(place["country"], F.lit(""))
    )
    return jobs.select(
        *carried(jobs),
        F.lit("workday").alias("source"),
        F.lit(None).cast("string").alias("source_job_id"),
        F.col("j.externalUrl").alias("source_url"),
        F.col("j.title").alias("title"),
        "company",
        F.when(place.isNull(), "").otherwise(located).alias("location"),
        F.lit("FULL_TIME").alias("employment_type"),
        F.concat("j.title", F.lit(" at "), "company").alias("description_text"),
        F.lit("ACTIVE").alias("status"),
        _day(F.col("j.postedOn")).alias("posted_at"),
    ), bad


def parse_detail(landing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Single postings; ``landing`` also has the ``url`` each came from."""
    read, bad = _read(landing, DETAIL_SCHEMA, None)
    return read.select(
        F.lit("workday").alias("source"),
        F.nullif("_r.jobReqId", F.lit("")).alias("source_job_id"),
        F.col("url").alias("source_url"),
        F.col("_r.title").alias("title"),
        "company",
        _text("_r.location").alias("location"),
        F.lit("FULL_TIME").alias("employment_type"),
        _text("_r.jobDescription").alias("description_text"),
        F.lit("ACTIVE").alias("status"),
        _day(F.col("_r.postedOn")).alias("posted_at"),
    ), bad


def fetch_report(landing: DataFrame) -> DataFrame:
    """Per company: responses, unreadable ones, and whether the run failed."""
    broken = F.try_parse_json(F.col("body")).isNull()
    return (
        landing.groupBy("company")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(broken).alias("errors"))
        .withColumn("failed", F.col("errors") > 0)
    )


def union_postings(*sources: DataFrame) -> DataFrame:
    """All sources as one table of postings; with the order of arrival if all of them carry it."""
    kept = ARRIVAL if all(set(ARRIVAL) <= set(source.columns) for source in sources) else []
    return reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True),
        [source.select(*JOB_FIELDS, *kept) for source in sources],
    ).withColumn("description_hash", content_hash(F.col("description_text")))
