"""Postings in Markdown and HTML tables.

Input ``pages``: ``page_id, body`` with one whole document per row, for instance from
``read_pages``, and perhaps ``fetched_at``. Output: one row per posting in the columns of ``JOB_FIELDS``,
its ``position`` on the page, and when that was fetched, if known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirespan.functions.text import apply_link, drop_markup, tidy_cell, trim_space, unescape_entities

# Source name of listings, the mark of "same company as above", patterns.
LISTING_SOURCE = "github-simplify"
SAME_COMPANY = "↳"
MARKDOWN_LINK = r"\[.*?\]\((https?://[^\)]+)\)"
HTML_ROW = r"(?is)<tr>(.*?)</tr>"
HTML_CELL = r"(?is)<td[^>]*>(.*?)</td>"

JOB_FIELDS = [
    "source", "source_job_id", "source_url", "title", "company", "location", "employment_type",
    "description_text", "status", "posted_at",
]

# When a response was fetched, and where in it a posting stands: the order in which postings arrived.
ARRIVAL = ["fetched_at", "position"]


def carried(rows: DataFrame) -> list[str]:
    """The columns of ``ARRIVAL`` that are there."""
    return [name for name in ARRIVAL if name in rows.columns]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as pages."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("page_id"), F.col("value").alias("body")
    )


def _as_jobs(rows: DataFrame) -> DataFrame:
    text = F.concat("role", F.lit(" at "), "company", F.lit(" - "), "location")
    return rows.select(
        "page_id",
        *carried(rows),
        F.lit(LISTING_SOURCE).alias("source"),
        F.sha2("link", 256).alias("source_job_id"),
        F.col("link").alias("source_url"),
        F.col("role").alias("title"),
        "company",
        "location",
        F.lit("INTERNSHIP").alias("employment_type"),
        text.alias("description_text"),
        F.lit("ACTIVE").alias("status"),
        F.lit(None).cast("timestamp").alias("posted_at"),
    )


def _complete() -> Column:
    return (F.col("company") != "") & (F.col("role") != "") & (F.col("link") != "")


def parse_markdown(pages: DataFrame) -> DataFrame:
    """Rows of ``|`` tables. Heading and rule lines are dropped, as is any line naming ``Company``."""
    when = carried(pages)
    lines = pages.select("page_id", *when, F.posexplode(F.split("body", "\n")).alias("position", "_line"))
    parts = F.split(F.col("_line"), r"\|")
    rows = (
        lines.withColumn("_line", trim_space(F.col("_line")))
        .where(F.col("_line").startswith("|"))
        .where(~F.col("_line").contains("Company") & ~F.col("_line").contains("---"))
        .where(F.size(parts) >= 5)
        .select(
            "page_id",
            *when,
            "position",
            trim_space(F.get(parts, F.lit(1))).alias("company"),
            trim_space(F.get(parts, F.lit(2))).alias("role"),
            trim_space(F.get(parts, F.lit(3))).alias("location"),
            F.regexp_extract(F.get(parts, F.lit(4)), MARKDOWN_LINK, 1).alias("link"),
        )
    )
    return _as_jobs(rows.where(_complete()))


def parse_html(pages: DataFrame) -> DataFrame:
    """Rows of HTML tables; a blank or arrow company takes the last one named above on the page."""
    when = carried(pages)

    def cell(cells: Column, index: int) -> Column:
        return tidy_cell(unescape_entities(drop_markup(F.get(cells, F.lit(index)))))

    rows = pages.select(
        "page_id",
        *when,
        F.posexplode(F.regexp_extract_all("body", F.lit(HTML_ROW), F.lit(1))).alias("position", "_row"),
    )
    cells = rows.select(
        "page_id", *when, "position", F.regexp_extract_all("_row", F.lit(HTML_CELL), F.lit(1)).alias("_cells")
    ).where(F.size("_cells") >= 4)
    read = cells.select(
        "page_id",
        *when,
        "position",
        cell(F.col("_cells"), 0).alias("company"),
        cell(F.col("_cells"), 1).alias("role"),
        cell(F.col("_cells"), 2).alias("location"),
        apply_link(F.get("_cells", F.lit(3))).alias("link"),
    )
    # A page is one input row, so its rows always fit one task.
    above = Window.partitionBy("page_id", *when).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(~F.col("company").isin(SAME_COMPANY, ""), F.col("company"))
    filled = read.withColumn("company", F.coalesce(F.last(named, ignorenulls=True).over(above), F.lit("")))
    return _as_jobs(filled.where(_complete()))


def parse_listings(pages: DataFrame) -> DataFrame:
    """HTML where a page holds a ``<table>``, Markdown otherwise."""
    has_table = F.col("body").contains("<table>")
    return parse_html(pages.where(has_table)).unionByName(parse_markdown(pages.where(~has_table)))
