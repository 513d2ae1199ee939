"""Periodic ingest of landed responses, and of stored resume responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hirespan.functions.records import parse_profiles
from hirespan.operators.skills import requirement_profiles
from hirespan.operators.tables import JOB_COLUMNS, upsert_jobs, upsert_latest
from hirespan.schemas import schema_of
from hirespan.sources import boards
from hirespan.sources.buckets import Buckets
from hirespan.sources.listings import ARRIVAL, parse_listings
from hirespan.sources.store import drop_versions, write_version

# Landed rows: kind of source, company, token, time of the fetch, and the whole response.
LANDING_SCHEMA = "kind string, company string, token string, fetched_at timestamp, body string"

PROFILE_SCHEMA = "resume_id {kind}, skills array<string>, years_experience int, education_level string, status string"
REQUIREMENTS = ["job_id", "required_skills", "preferred_skills"]
BUCKETS = 16  # for tables of some gigabytes; give more for larger ones


def postings_of(landing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(postings, rejects)`` of all kinds of landed responses, postings with the order of their arrival."""
    of = {kind: landing.where(F.col("kind") == kind) for kind in ("board", "postings", "list", "listing")}
    pages = of["listing"].select(
        F.xxhash64("company", "token", "fetched_at", "body").alias("page_id"), "fetched_at", "body"
    )
    board, board_rejects = boards.parse_board(of["board"])
    posts, post_rejects = boards.parse_postings(of["postings"])
    lists, list_rejects = boards.parse_list(of["list"])
    rejects = board_rejects.unionByName(post_rejects).unionByName(list_rejects)
    return boards.union_postings(parse_listings(pages), board, posts, lists), rejects


def _columns(table: str, names: list[str]) -> StructType:
    fields = schema_of(table)
    return StructType([fields[name] for name in names])


def jobs_table(path: str, buckets: int = BUCKETS) -> Buckets:
    """With a mark of the rows which the batch that wrote a bucket last had touched."""
    return Buckets(f"{path}/jobs", ["source_url"], _columns("jobs", JOB_COLUMNS).add("touched", "boolean"), buckets)


def owners_table(path: str, buckets: int = BUCKETS) -> Buckets:
    """Which URL a source's own key belongs to."""
    names = ["source", "source_job_id", "source_url"]
    return Buckets(f"{path}/owners", names[:2], _columns("jobs", names), buckets)


def requirements_table(path: str, buckets: int = BUCKETS) -> Buckets:
    return Buckets(f"{path}/requirements", ["job_id"], _columns("job_requirement_profiles", REQUIREMENTS), buckets)


def ingest_batch(path: str, as_of: Column, buckets: int = BUCKETS):
    """A batch handler: parse, upsert the jobs, extract skills, keep rejects.

    Jobs, the owners of source keys, and requirements are bucketed tables: a batch reads and writes the
    buckets of its own URLs, keys and jobs only. Within a batch the text fetched last counts, and of one
    response the posting that stands last in it.
    """
    jobs, owners, needs = jobs_table(path, buckets), owners_table(path, buckets), requirements_table(path, buckets)

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if any(table.staged(spark, number) is None for table in (jobs, owners, needs)):
            work(batch, number)
        for table in (jobs, owners, needs):
            table.put(spark, number)

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        postings, rejects = postings_of(batch)
        # Equal places in two responses of one moment are told apart by what they hold.
        arrival = F.struct(*ARRIVAL, F.xxhash64("source_url", "title", "description_hash").alias("content"))
        arrived = postings.withColumns(
            {
                "scraped_at": as_of.cast("timestamp"),
                "arrival": arrival,
                "minimum_years_experience": F.lit(None).cast("int"),
                "education_level": F.lit(None).cast("string"),
            }
        )
        # Parsed once and written, then used several times.
        write_version(arrived, f"{path}/arrived", number)
        arrived = spark.read.parquet(f"{path}/arrived/v={number:012d}")
        urls = arrived.select("source_url").where("source_url is not null").distinct()
        keyed = arrived.select("source", "source_job_id").where("source_job_id is not null").distinct()
        present, taken = jobs.met_by(urls), owners.met_by(keyed)
        merged, clashes = upsert_jobs(present, arrived, as_of, owners=taken, touched="touched")
        jobs.stage(merged, number)
        merged = jobs.staged(spark, number).drop("bucket")
        added = merged.where("source_job_id is not null").join(present.select("source_url"), "source_url", "left_anti")
        owners.stage(taken.unionByName(added.select(*taken.columns)), number)
        # The mark spares a join in which all texts of the buckets would be shuffled and sorted.
        touched = requirement_profiles(merged.where("touched")).select(*REQUIREMENTS)
        older = needs.met_by(touched).join(touched.select("job_id"), "job_id", "left_anti")
        needs.stage(older.unionByName(touched), number)
        refused = rejects.select("company", "body", "reason").unionByName(
            clashes.select("source_url", "reason"), allowMissingColumns=True
        )
        write_version(refused, f"{path}/rejects", number)
        drop_versions(spark, f"{path}/arrived", before=number + 1)

    return handle


def present_jobs(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """All jobs an ingest keeps under ``path``."""
    return jobs_table(path, buckets).read(spark).drop("touched")


def present_requirements(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    return requirements_table(path, buckets).read(spark)


def profiles_table(path: str, kind: str = "string", buckets: int = BUCKETS) -> Buckets:
    return Buckets(path, ["resume_id"], PROFILE_SCHEMA.format(kind=kind), buckets)


def profile_batch(path: str, kind: str = "string", buckets: int = BUCKETS):
    """A batch handler for stored resume responses ``resume_id, response, received_at``.

    The last response of a resume in a batch counts, over those of earlier batches. ``kind`` is the type of the id.
    """
    table = profiles_table(path, kind, buckets)

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if table.staged(spark, number) is None:
            read, _ = parse_profiles(batch.where("resume_id is not null"))
            rows = read.select(*table.schema.names, "received_at")
            table.stage(upsert_latest(table.met_by(batch), rows, ["resume_id"], ["received_at"]), number)
        table.put(spark, number)

    return handle


def present_profiles(spark: SparkSession, path: str, kind: str = "string", buckets: int = BUCKETS) -> DataFrame:
    return profiles_table(path, kind, buckets).read(spark)
