"""The job feed: filters, order, pages, and its summary row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from hirespan.functions.text import keyword_match, normal_skills

# Page size if the asked one is out of range, and that range.
DEFAULT_SIZE, LARGEST_SIZE = 20, 100
# Rows that are sorted for a page without looking for narrower ranges.
FEW_ROWS = 1_000_000

SUMMARY_COLUMNS = [
    "job_id", "title", "company", "location", "employment_type", "posted_at", "scraped_at", "status", "source_url",
]
DETAIL_COLUMNS = [*SUMMARY_COLUMNS, "description_text"]


def effective_date() -> Column:
    return F.coalesce("posted_at", "scraped_at")


def is_active() -> Column:
    return F.col("status") == "ACTIVE"


def like_part(column: str, part: str) -> Column:
    """Case-insensitive search; ``%`` and ``_`` of the user stay wildcards."""
    return F.lower(column).like(f"%{part}%".lower())


def is_remote() -> Column:
    return F.lower("location").contains("remote")


def feed_conditions(
    location: str | None = None,
    remote: bool | None = None,
    company: str | None = None,
    search: str | None = None,
) -> list[Column]:
    """Only conditions asked for, so the plan carries no dead filters."""
    conditions = [is_active()]
    if location is not None:
        conditions.append(like_part("location", location))
    if remote:
        conditions.append(is_remote())
    if company is not None:
        conditions.append(like_part("company", company))
    if search is not None:
        conditions.append(like_part("title", search) | like_part("company", search))
    return conditions


def filter_feed(jobs: DataFrame, **filters) -> DataFrame:
    for condition in feed_conditions(**filters):
        jobs = jobs.where(condition)
    return jobs


def feed_order(jobs: DataFrame) -> DataFrame:
    """Newest first by posted, else scraped date; ties by id."""
    return jobs.orderBy(effective_date().desc(), "job_id")


def page_of(frame: DataFrame, page: int, size: int) -> DataFrame:
    """One page of an ordered frame."""
    page = max(page, 0)
    size = size if 1 <= size <= LARGEST_SIZE else DEFAULT_SIZE
    return frame.offset(page * size).limit(size)


def feed_page(
    jobs: DataFrame, page: int = 0, size: int = 100, profile: DataFrame | None = None, **filters
) -> DataFrame:
    """A page of the filtered feed; with a one-row ``profile`` also its match percentage."""
    rows = page_of(feed_order(filter_feed(jobs, **filters)), page, size)
    # The page is small and in order, so it is not dealt out.
    return rows if profile is None else _match(rows, profile)


def deep_page(rows: DataFrame, page: int, size: int) -> DataFrame:
    """One page of the feed, however far down, without sorting what is above it.

    Counts per day of the sort key say in which days the page lies, at most as many as it has rows; if these
    hold many rows, counts per second narrow them down again. Only rows of those ranges are sorted.
    """
    page = max(page, 0)
    size = size if 1 <= size <= LARGEST_SIZE else DEFAULT_SIZE
    start = page * size
    for unit in ("DAY", "SECOND"):
        rows = rows.withColumn("_range", F.date_trunc(unit, effective_date()))
        running = Window.orderBy(F.col("_range").desc_nulls_last())
        counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.withColumn("before", F.sum("n").over(running) - F.col("n"))
        met = counts.where((F.col("before") < start + size) & (F.col("before") + F.col("n") > start)).collect()
        if not met:
            return rows.drop("_range").limit(0)
        wanted = rows.sparkSession.createDataFrame([(r["_range"],) for r in met], counts.select("_range").schema)
        rows = rows.join(F.broadcast(wanted), rows["_range"].eqNullSafe(wanted["_range"]), "left_semi").drop("_range")
        start -= min(r["before"] for r in met)
        if sum(r["n"] for r in met) <= FEW_ROWS:
            break
    return feed_order(rows).offset(start).limit(size)


def served_page(
    jobs: DataFrame, page: int = 0, size: int = 100, profile: DataFrame | None = None, **filters
) -> DataFrame:
    """A page as it is served: its jobs in order, each with ``position``, ``total`` and ``last_sync``.

    One scan gives the page, the rows under the filters and the newest date of all active jobs: the latter two are
    observed while rows pass on to the sort, which keeps a page's worth of them per task. The match with a
    ``profile`` is worked out for the page only. A page without jobs has no rows.
    """
    matching = F.lit(True)
    for condition in feed_conditions(**filters):
        matching = matching & F.coalesce(condition, F.lit(False))
    seen = Observation()
    observed = jobs.where(is_active()).observe(
        seen, F.count_if(matching).alias("total"), F.max(effective_date()).alias("last_sync")
    )
    rows = page_of(feed_order(observed.where(matching)), page, size)
    spark = jobs.sparkSession
    held = rows.collect()  # at most LARGEST_SIZE rows
    about = seen.get
    schema = rows.schema.add("position", "long").add("total", "long").add("last_sync", jobs.select(effective_date()).schema[0].dataType)
    served = [(*row, at, about["total"], about["last_sync"]) for at, row in enumerate(held)]
    out = spark.createDataFrame(served, schema)
    return out if profile is None else _match(out, profile)


def job_details(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The details of active jobs among the wanted ids."""
    return active_job(jobs, wanted).select(*DETAIL_COLUMNS)


def with_match(jobs: DataFrame, profile: DataFrame) -> DataFrame:
    """Jobs with the match percentage of one profile (a single row with ``skills``)."""
    return _match(jobs, profile)


def _match(jobs: DataFrame, profile: DataFrame) -> DataFrame:
    # The skills come in as one text: a subquery may not stand inside an array function.
    mark = "\u001f"
    skills = profile.select(F.array_join(normal_skills(F.col("skills")), mark)).scalar()
    wanted = F.split(F.nullif(F.col("_skills"), F.lit("")), mark)
    return (
        jobs.withColumn("_skills", skills)
        .withColumn("match_percentage", keyword_match(wanted, F.col("description_text")))
        .drop("_skills")
    )


def feed_summary(jobs: DataFrame, **filters) -> DataFrame:
    """One row: rows under the filters, and the newest date of all active jobs, in one pass."""
    matching = F.lit(True)
    for condition in feed_conditions(**filters):
        matching = matching & F.coalesce(condition, F.lit(False))
    return jobs.where(is_active()).agg(
        F.count_if(matching).alias("total"), F.max(effective_date()).alias("last_sync")
    )


def last_sync(jobs: DataFrame) -> DataFrame:
    return jobs.where(is_active()).agg(F.max(effective_date()).alias("last_sync"))


def active_count(jobs: DataFrame) -> DataFrame:
    return jobs.where(is_active()).agg(F.count(F.lit(1)).alias("total_jobs"))


def active_job(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Active jobs among the wanted ids; the rest is simply not found."""
    return jobs.where(is_active()).join(wanted.select("job_id").distinct(), "job_id", "left_semi")


def newest(jobs: DataFrame, count: int = 5) -> DataFrame:
    """The newest active jobs by posted date."""
    return jobs.where(is_active()).orderBy(F.col("posted_at").desc_nulls_last(), "job_id").limit(count)


def in_tab(tab: str) -> Column:
    """Condition of the ``intern`` or ``new-grad`` tab."""
    typed = F.upper(F.coalesce("employment_type", F.lit(""))) == "INTERNSHIP"
    title = F.lower("title")
    if tab == "intern":
        return typed | title.contains("intern")
    return ~(typed & ~title.contains("new grad"))


def haystack_contains(text: str) -> Column:
    """Title, company and location searched as one text."""
    return F.lower(F.concat_ws(" ", "title", "company", "location")).contains(text.strip().lower())


def hide_applied(feed: DataFrame, applications: DataFrame, on: list[str]) -> DataFrame:
    return feed.join(applications.select(*on), on, "left_anti")


def mark_feed(feed: DataFrame, saved: DataFrame, applications: DataFrame, on: list[str]) -> DataFrame:
    """``is_saved`` and ``already_applied`` flags; both tables hold each key once."""
    return (
        feed.join(saved.select(*on, F.lit(True).alias("_saved")), on, "left")
        .join(applications.select(*on, F.lit(True).alias("_applied")), on, "left")
        .withColumn("is_saved", F.col("_saved").isNotNull())
        .withColumn("already_applied", F.col("_applied").isNotNull())
        .drop("_saved", "_applied")
    )
