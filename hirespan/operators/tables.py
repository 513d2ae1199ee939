"""Keeping tables current: upserts, closings, deletes, status logs.

Plain Parquet has no MERGE, so each function gives the next state of a table from its present state
and a batch. Of a large table that is the part a batch touches (``sources.buckets``). Batches are first reduced to one row per key by an aggregate that Spark combines before the shuffle, so a
key repeated any number of times costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirespan.functions.text import _trim_control, content_hash

# Columns an upsert refreshes on an existing posting; all others but the dates and the status stay.
REFRESHED = ["title", "company", "location", "employment_type", "description_text", "description_hash"]
JOB_COLUMNS = [
    "job_id", "source", "source_job_id", "source_url", "title", "company", "location", "employment_type",
    "description_text", "description_hash", "status", "minimum_years_experience", "education_level",
    "posted_at", "scraped_at", "created_at", "updated_at",
]


def _fold_batch(batch: DataFrame) -> DataFrame:
    """One row per URL: identity of its first arrival, text of its last, first known posted date."""
    order = F.struct("scraped_at", "arrival")
    first_names = ["source", "source_job_id", "minimum_years_experience", "education_level"]
    last_names = [c for c in REFRESHED if c != "description_hash"]
    dated = F.when(F.col("posted_at").isNotNull(), order)
    return (
        batch.where("source_url is not null")
        .groupBy("source_url")
        .agg(
            F.min(F.struct(order.alias("o"), F.struct(*first_names).alias("r"))).alias("_first"),
            F.max(F.struct(order.alias("o"), F.struct(*last_names).alias("r"))).alias("_last"),
            F.min_by("posted_at", dated).alias("posted_at"),
            F.max("scraped_at").alias("scraped_at"),
        )
        .select(
            "source_url",
            *[F.col(f"_first.r.{c}").alias(c) for c in first_names],
            *[F.col(f"_last.r.{c}").alias(c) for c in last_names],
            "posted_at",
            "scraped_at",
            F.col("_first.o").alias("_order"),
        )
        .withColumn("source_job_id", F.nullif("source_job_id", F.lit("")))
        .withColumn("description_hash", content_hash(F.col("description_text")))
    )


def upsert_jobs(
    target: DataFrame, batch: DataFrame, as_of: Column, owners: DataFrame | None = None, touched: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(next table, rejects)``.

    ``target`` may be a part of the table that holds all URLs of the batch, if ``owners`` (source,
    source_job_id) then holds those of the batch's source keys that are taken in all of it.
    ``touched`` names a further column of the next table, which says of which rows the batch gave the text.

    ``batch`` rows carry the posting's columns, ``scraped_at`` and a unique ``arrival``. A known
    URL gets the newest text, becomes active again, and keeps its identity and its first
    known posted date. A new URL is added, unless its (source, source key) belongs to another
    URL, in the table or earlier in the batch: such rows are rejected, as are rows without a URL.
    """
    folded = _fold_batch(batch)
    fresh = folded.join(target.select("source_url"), "source_url", "left_anti")
    # Rows without a source key cannot clash; keeping them out also keeps nulls out of the joins.
    # The filters are spelt out so that both uses of these rows share one shuffle.
    keyed = fresh.where("source is not null and source_job_id is not null")
    keys = ["source", "source_job_id"]
    winners = keyed.groupBy(*keys).agg(F.min(F.struct("_order", "source_url")).alias("_w"))
    owners = target if owners is None else owners
    taken = owners.where("source_job_id is not null").select(*keys, F.lit(True).alias("_taken"))
    clashes = (
        keyed.join(winners, keys)
        .join(taken, keys, "left")
        .where((F.col("_w.source_url") != F.col("source_url")) | F.col("_taken").isNotNull())
        .select("source_url", *keys, F.lit("source key belongs to another url").alias("reason"))
    )
    nameless = batch.where("source_url is null").select("source_url", *keys, F.lit("url is missing").alias("reason"))
    accepted = folded.join(clashes.select("source_url"), "source_url", "left_anti")
    old = target.select("source_url", F.struct(*[c for c in JOB_COLUMNS if c != "source_url"]).alias("_old"))
    new = accepted.select(
        "source_url", F.struct(*[c for c in accepted.columns if c not in ("source_url", "_order")]).alias("_new")
    )
    is_old, is_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    moment = as_of.cast("timestamp")

    def kept(name: str) -> Column:
        return F.when(is_old, F.col(f"_old.{name}")).otherwise(F.col(f"_new.{name}"))

    def refreshed(name: str) -> Column:
        return F.when(is_new, F.col(f"_new.{name}")).otherwise(F.col(f"_old.{name}"))

    values = {
        "job_id": F.coalesce("_old.job_id", F.sha2("source_url", 256)),
        "source_url": F.col("source_url"),
        "status": F.when(is_new, F.lit("ACTIVE")).otherwise(F.col("_old.status")),
        "posted_at": F.coalesce("_old.posted_at", "_new.posted_at"),
        "scraped_at": refreshed("scraped_at"),
        "created_at": F.coalesce(F.col("_old.created_at"), moment),
        "updated_at": F.when(is_new, moment).otherwise(F.col("_old.updated_at")),
    }
    for name in JOB_COLUMNS:
        if name not in values:
            values[name] = refreshed(name) if name in REFRESHED else kept(name)
    marks = [is_new.alias(touched)] if touched else []
    merged = old.join(new, "source_url", "full_outer").select(*[values[c].alias(c) for c in JOB_COLUMNS], *marks)
    return merged, clashes.unionByName(nameless)


def upsert_latest(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows replaced by the batch's last row of their key; other rows stay; new keys are added.

    ``batch`` holds the target's columns and those of ``order``.
    """
    payload = [c for c in target.columns if c not in keys]
    last = (
        batch.groupBy(*keys)
        .agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])
    )
    stay = target.join(last.select(*keys), keys, "left_anti")
    return stay.unionByName(last.select(*target.columns))


def close_stale(jobs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Active postings not seen for ``days`` become closed."""
    moment = as_of.cast("timestamp")
    stale = (F.col("status") == "ACTIVE") & (F.col("scraped_at").cast("timestamp") < moment - F.make_interval(days=F.lit(days)))
    closed = {"status": F.when(stale, F.lit("CLOSED")).otherwise(F.col("status"))}
    if "updated_at" in jobs.columns:
        closed["updated_at"] = F.when(stale, moment).otherwise(F.col("updated_at"))
    return jobs.withColumns(closed)


# Answers that mean the page is gone.
DEAD_CODES = [404, 410]


def _dead(probes: DataFrame) -> DataFrame:
    """Jobs whose newest probe found the page gone."""
    newest = F.max_by(F.struct("status_code", "error"), F.struct("checked_at", "probe_id"))
    return (
        probes.groupBy("job_id")
        .agg(newest.alias("_p"))
        .select("job_id", F.coalesce(F.col("_p.status_code").isin(DEAD_CODES), F.lit(False)).alias("_dead"),
                F.col("_p.error").isNotNull().alias("_failed"))
    )


def close_dead(jobs: DataFrame, probes: DataFrame) -> DataFrame:
    """Active postings whose page is gone become closed; failed probes change nothing."""
    dead = _dead(probes).where("_dead and not _failed").select("job_id", "_dead")
    gone = F.col("_dead").isNotNull() & (F.col("status") == "ACTIVE")
    return (
        jobs.join(dead, "job_id", "left")
        .withColumn("status", F.when(gone, F.lit("CLOSED")).otherwise(F.col("status")))
        .drop("_dead")
    )


def probe_counters(jobs: DataFrame, probes: DataFrame) -> DataFrame:
    """One row about a liveness run: active jobs, those closed, and failed probes."""
    checked = jobs.where(F.col("status") == "ACTIVE").select("job_id").join(_dead(probes), "job_id", "left")
    return checked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_dead") & ~F.col("_failed")).alias("pruned"),
        F.count_if(F.col("_failed")).alias("errors"),
    )


def delete_rows(rows: DataFrame, deletions: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(deletions.select(*keys), keys, "left_anti")


def latest_status(log: DataFrame, key: str) -> DataFrame:
    """Current status per key of a status log ``key, status, ts, event_id``."""
    order = F.struct("ts", "event_id")
    return log.groupBy(key).agg(F.max_by("status", order).alias("status"), F.max("ts").alias("changed_at"))


def find_or_create_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Users to add: logins ``email, name, login_id`` whose address is unknown, once each.

    Addresses are trimmed and lower-cased; a blank name falls back to the part before the ``@``.
    """
    cleaned = logins.withColumn("email", F.lower(_trim_control(F.col("email")))).where("email <> ''")
    named = cleaned.withColumn(
        "display_name",
        F.coalesce(F.nullif(_trim_control(F.col("name")), F.lit("")), F.split_part("email", F.lit("@"), F.lit(1))),
    )
    first = named.groupBy("email").agg(F.min_by("display_name", "login_id").alias("display_name"))
    known = users.select(F.lower(_trim_control(F.col("email"))).alias("email"))
    return first.join(known, "email", "left_anti").select(
        F.sha2("email", 256).alias("user_id"), "email", "display_name", F.lit("PRIVATE").alias("profile_visibility")
    )
