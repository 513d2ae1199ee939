"""Attempts over a limit per client, as an audit of an event log.

Each client has a bucket of ``allowed`` attempts. It is full at the client's first attempt and is filled up
again whenever another ``span`` has passed since then; an attempt that finds it empty is refused and takes
nothing. As a refill fills the bucket whatever is left in it, an interval's refused attempts are those
beyond ``allowed``, and attempts of an interval can be counted in any order and in any number of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirespan.sources.buckets import Buckets
from hirespan.sources.store import exists, write_version

# Attempts allowed per interval, and its length.
ALLOWED, SPAN = 5, "1 minute"


def _interval_start(first: Column, when: Column, span: str) -> Column:
    """Start of the interval an attempt lies in; one that arrives late, from before the first, is in the first."""
    length = (F.expr(f"timestamp_seconds(0) + interval {span}").cast("double") * 1_000_000).cast("long")
    passed = F.greatest(F.unix_micros(when) - F.unix_micros(first), F.lit(0))
    return F.timestamp_micros(F.unix_micros(first) + passed - passed % length)


def _over(counts: DataFrame, client: str, allowed: int) -> DataFrame:
    return counts.where(F.col("attempts") > allowed).select(
        client, "window_start", "attempts", (F.col("attempts") - allowed).alias("refused")
    )


def _counted(events: DataFrame, firsts: DataFrame, client: str, when: str, span: str) -> DataFrame:
    """Attempts per client and interval; both sums are combined before they are shuffled."""
    started = events.select(client, when).join(firsts.select(client, "first"), client)
    start = _interval_start(F.col("first"), F.col(when), span).alias("window_start")
    return started.groupBy(client, start).agg(F.count(F.lit(1)).alias("attempts"))


def attempts_over_limit(events: DataFrame, client: str, when: str, allowed: int = ALLOWED, span: str = SPAN) -> DataFrame:
    """Clients and intervals with refused attempts."""
    known = events.where(F.col(client).isNotNull() & F.col(when).isNotNull())
    firsts = known.groupBy(client).agg(F.min(when).alias("first"))
    return _over(_counted(known, firsts, client, when, span), client, allowed)


def attempts_batch(path: str, client: str, kind: str, when: str, span: str = SPAN, buckets: int = 16):
    """A batch handler that counts attempts as they arrive.

    What is kept is every client's first attempt; a batch writes its own counts, which are added to those of
    other batches when they are read. Open intervals are counted like any other. ``kind`` is the client's type.
    """
    table = _clients(path, client, kind, buckets)

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = batch.where(F.col(client).isNotNull() & F.col(when).isNotNull())
        if table.staged(spark, number) is None:
            fresh = known.groupBy(client).agg(F.min(when).alias("first"))
            before = table.met_by(fresh)
            table.stage(before.unionByName(fresh.join(before, client, "left_anti")), number)
        firsts = table.staged(spark, number)
        write_version(_counted(known, firsts, client, when, span), f"{path}/counts", number)
        table.put(spark, number)

    return handle


def _clients(path: str, client: str, kind: str, buckets: int) -> Buckets:
    return Buckets(f"{path}/clients", [client], f"{client} {kind}, first timestamp", buckets)


def attempts_found(spark: SparkSession, path: str, client: str, kind: str, allowed: int = ALLOWED) -> DataFrame:
    """Clients and intervals with refused attempts, from what the batches counted under ``path``."""
    schema = f"{client} {kind}, window_start timestamp, attempts long"
    if not exists(spark, f"{path}/counts"):
        return _over(spark.createDataFrame([], schema), client, allowed)
    counts = spark.read.schema(schema).parquet(f"{path}/counts")
    return _over(counts.groupBy(client, "window_start").agg(F.sum("attempts").alias("attempts")), client, allowed)
