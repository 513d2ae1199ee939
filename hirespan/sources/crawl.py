"""Which pages of a search list to ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows per page, and the most rows one search can list.
PAGE_SIZE, MOST_ROWS = 20, 2000


def _offsets(total: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.when(total > 0, F.sequence(F.lit(0), F.greatest(total, F.lit(1)) - 1, F.lit(PAGE_SIZE))).otherwise(none)


def crawl_plan(totals: DataFrame) -> DataFrame:
    """``company, facet, page_offset`` from ``company, total, facets array<struct<title, count>>``.

    Up to 2000 rows are paged as they are. Above that each location facet is paged on its own,
    leaving out facets which are too large themselves; without facets the first 2000 are paged.
    """
    whole = F.struct(F.lit(None).cast("string").alias("title"), F.least("total", F.lit(MOST_ROWS)).alias("count"))
    facets = F.filter("facets", lambda facet: facet["count"] <= MOST_ROWS)
    split = (F.col("total") > MOST_ROWS) & (F.size("facets") > 0)
    searches = totals.select("company", F.explode(F.when(split, facets).otherwise(F.array(whole))).alias("s"))
    return searches.select(
        "company", F.col("s.title").alias("facet"), F.explode(_offsets(F.col("s.count"))).alias("page_offset")
    )


def skipped_searches(totals: DataFrame) -> DataFrame:
    """``company, facet, rows, reason``: what a crawl plan cannot reach, with the number of rows it leaves out.

    Facets that are too large themselves are left out whole; without facets, what lies beyond the first 2000 is.
    """
    large = totals.where(F.col("total") > MOST_ROWS)
    facets = large.select("company", F.explode("facets").alias("f")).where(F.col("f.count") > MOST_ROWS)
    whole = large.where(F.coalesce(F.size("facets"), F.lit(0)) <= 0)
    return facets.select(
        "company", F.col("f.title").alias("facet"), F.col("f.count").alias("rows"), F.lit("facet is too large").alias("reason")
    ).unionByName(
        whole.select(
            "company", F.lit(None).cast("string").alias("facet"), (F.col("total") - MOST_ROWS).alias("rows"),
            F.lit("too many rows and no facets").alias("reason"),
        )
    )
