"""CSV and sitemap exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Label of each status in exports, header of the CSV.
STATUS_LABELS = {
    "APPLIED": "Applied", "SCORED": "Applied", "INTERVIEWING": "Interviewing", "OFFER": "🎉 Offer",
    "REJECTED": "Rejected", "WITHDRAWN": "Withdrawn", "FAILED": "Failed",
}
CSV_HEADER = ["Company", "Role", "Status", "Match Score", "Applied Date", "Deadline", "Notes"]


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(part) for pair in STATUS_LABELS.items() for part in pair])
    return F.coalesce(F.try_element_at(labels, status), status)


def application_export(applications: DataFrame) -> DataFrame:
    """The seven export columns of an application list, all text."""
    def given(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in applications.columns else F.lit("")

    score = F.when(F.col("match_score") > 0, F.concat(F.col("match_score").cast("string"), F.lit("/100"))).otherwise("—")
    values = [
        F.col("company"),
        F.col("job_title"),
        status_label(F.col("status")),
        score,
        F.coalesce(F.date_format("applied_at", "MMM d, yyyy"), F.lit("—")),
        given("deadline"),
        given("notes"),
    ]
    return applications.select(*[value.alias(name) for value, name in zip(values, CSV_HEADER)])


# Doubled quotes; an empty cell is written as a quoted one and read as text.
CSV_FORMAT = {"header": True, "quote": '"', "escape": '"', "emptyValue": ""}
# Most addresses in one file of a sitemap, and the elements it is made of.
MOST_ADDRESSES = 50_000
SITEMAP_SCHEMA = "loc string, lastmod timestamp, changefreq string, priority double"


def write_csv(rows: DataFrame, path: str) -> None:
    """Quoted CSV with a header per part; quotes inside a cell are doubled.

    Parts show once all tasks are done: what a failed task has written is not among them.
    """
    rows.write.mode("overwrite").csv(path, quoteAll=True, **CSV_FORMAT | {"emptyValue": '""'})


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A written export, all cells as text."""
    schema = StructType([StructField(name, StringType()) for name in CSV_HEADER])
    return spark.read.schema(schema).csv(path, multiLine=True, nullValue="\u0000", **CSV_FORMAT)


def write_sitemap(rows: DataFrame, path: str, most: int = MOST_ADDRESSES) -> None:
    """XML files of at most ``most`` addresses each."""
    named = rows.select(
        F.col("url").alias("loc"), F.col("last_modified").alias("lastmod"), F.col("change_frequency").alias("changefreq"), "priority"
    )
    writer = named.write.mode("overwrite").format("xml").option("rootTag", "urlset").option("rowTag", "url")
    writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").option("maxRecordsPerFile", most).save(path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(SITEMAP_SCHEMA).format("xml").option("rowTag", "url")
    return reader.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").load(path).select(
        F.col("loc").alias("url"), F.col("changefreq").alias("change_frequency"), "priority", F.col("lastmod").alias("last_modified")
    )


def sitemap(jobs: DataFrame, site: str, as_of: Column) -> DataFrame:
    """Start page, login page, and every active job with its last change."""
    site = site.rstrip("/")
    active = jobs.where(F.col("status") == "ACTIVE")
    changed = F.coalesce("posted_at", "scraped_at").cast("timestamp")
    pages = active.select(
        F.concat(F.lit(f"{site}/jobs/"), F.col("job_id").cast("string")).alias("url"),
        F.lit("hourly").alias("change_frequency"),
        F.lit(0.8).alias("priority"),
        changed.alias("last_modified"),
    )
    moment = as_of.cast("timestamp")
    home = active.agg(F.max(changed).alias("last")).select(
        F.lit(f"{site}/").alias("url"), F.lit("hourly").alias("change_frequency"), F.lit(1.0).alias("priority"),
        F.coalesce("last", moment).alias("last_modified"),
    )
    login = jobs.sparkSession.range(1).select(
        F.lit(f"{site}/login").alias("url"), F.lit("monthly").alias("change_frequency"), F.lit(0.5).alias("priority"),
        moment.alias("last_modified"),
    )
    return home.unionByName(login).unionByName(pages)
