"""Keeping one hot key from landing in one task.

``salted_join`` spreads the rows of heavy keys over several join keys.
``with_order_slices`` cuts the ordered rows of heavy keys into value ranges, so that a running
count can be taken per slice and completed with the sums of the slices before it.

Both find heavy keys from a count per key. A key counts as heavy when it holds more than
``1 / parts`` of all rows, so there are fewer than ``parts`` of them whatever the data: that is
the bound which makes broadcasting the list of heavy keys safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sampled rows per slice when looking for slice bounds. The sample only places the bounds.
SAMPLES_PER_SLICE = 16


# Most parts a table may be cut into, so that what is broadcast about the parts stays small.
MOST_PARTS = 8192


def checked_parts(df: DataFrame, parts: int | None) -> int:
    """``parts``, by default as many as shuffles have; more than ``MOST_PARTS`` are refused."""
    parts = parts or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    if parts > MOST_PARTS:
        raise ValueError(f"{parts} parts asked for, at most {MOST_PARTS} are possible")
    return parts


def spread(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """``rows`` dealt out evenly over ``parts`` tasks, for costly work on each of few large row groups.

    A table of many files needs none of this: its splits are dealt out as they are read.
    """
    return rows.repartition(checked_parts(rows, parts))


def with_value(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column which is worked out once per row.

    A filter on a plain column would be moved below it, working the value out twice.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def heavy_keys(df: DataFrame, keys: list[str], parts: int, floor: int = 0) -> DataFrame:
    """Keys with more than ``total / parts`` rows (and more than ``floor``), with ``n_rows`` and ``n_total``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    # Counted in the rows: summed up from the counts per key, these would be shuffled a second time.
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        counts.where(F.col("n_rows") > F.lit(floor))
        .where(F.col("n_rows") * F.lit(parts) > total)
        .select(*keys, "n_rows", total.alias("n_total"))
    )


def shares_of(counted: DataFrame, on: list[str], parts: int | None = None, floor: int = 0) -> DataFrame:
    """Keys that are heavy in ``counted``, and over how many ``_shares`` their rows are dealt."""
    parts = checked_parts(counted, parts)
    return heavy_keys(counted, on, parts, floor).select(
        *on, F.ceil(F.col("n_rows") * F.lit(parts) / F.col("n_total")).cast("int").alias("_shares")
    )


def with_salt(rows: DataFrame, shares: DataFrame, on: list[str], spread_by: list[str]) -> DataFrame:
    """Add ``_salt``, the share of its key that a row belongs to by a hash of ``spread_by``."""
    share = F.pmod(F.xxhash64(*spread_by), F.col("_shares")).cast("int")
    salt = F.when(F.col("_shares").isNull(), F.lit(0)).otherwise(share)
    return rows.join(F.broadcast(shares), on, "left").withColumn("_salt", salt).drop("_shares")


def salted_join(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    parts: int | None = None,
    floor: int = 0,
    counted: DataFrame | None = None,
    shares: DataFrame | None = None,
) -> DataFrame:
    """Join ``fact`` to ``dim`` on ``on``, spreading heavy keys of ``fact`` over several tasks.

    Rows of a heavy key are dealt out by a hash of ``spread_by``; the matching ``dim`` rows are
    repeated once per share, and only those. ``how`` is ``inner`` or ``left``. Where ``fact`` is costly, keys
    may be ``counted`` in the rows it was made of; that places the shares only. With ``shares``, ``fact`` bears the
    ``_salt`` it got for these, and if it lies by key and salt already it is not shuffled.
    """
    left = fact
    if shares is None:
        shares = shares_of(fact if counted is None else counted, on, parts, floor)
        left = with_salt(fact, shares, on, spread_by)
    right = (
        dim.join(F.broadcast(shares), on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_shares"), F.lit(1)) - 1)))
        .drop("_shares")
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def position_in(bounds: Column, key: Column, max_doublings: int = 20) -> Column:
    """How many elements of the sorted array ``bounds`` are below ``key`` (binary search)."""
    steps = F.array(*[F.lit(1 << power) for power in reversed(range(max_doublings))])

    def advance(position: Column, step: Column) -> Column:
        candidate = position + step
        inside = candidate <= F.size(bounds)
        # greatest/least keep the index legal when the candidate lies outside the array
        probe = F.get(bounds, F.least(candidate, F.size(bounds)) - 1)
        return F.when(inside & (probe < key), candidate).otherwise(position)

    return F.aggregate(steps, F.lit(0), advance)


def with_order_slices(
    df: DataFrame,
    key: str,
    order: list[str],
    parts: int | None = None,
    floor: int = 0,
) -> DataFrame:
    """Add ``slice`` (0 for all but heavy keys) and ``is_sliced``; slices follow ``order``.

    ``order`` must be unique within a key. Bounds come from a hash-based sample, so every run
    of the plan, and every retry of a task, sees the same slices.
    """
    parts = checked_parts(df, parts)
    heavy = heavy_keys(df, [key], parts, floor)
    point = F.struct(*order)
    one_in = F.greatest(
        F.lit(1), F.floor(F.col("n_total") / F.lit(parts * SAMPLES_PER_SLICE))
    ).cast("long")
    bounds = (
        df.select(key, *order)
        .join(F.broadcast(heavy), key)
        .where(F.pmod(F.xxhash64(*order), one_in) == 0)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(point)).alias("_sample"))
        .select(
            key,
            F.filter(
                "_sample", lambda _, position: (position + 1) % F.lit(SAMPLES_PER_SLICE) == 0
            ).alias("_bounds"),
        )
    )
    return (
        df.join(F.broadcast(bounds), key, "left")
        .withColumn(
            "slice",
            F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(position_in(F.col("_bounds"), point)),
        )
        .withColumn("is_sliced", F.col("_bounds").isNotNull())
        .drop("_bounds")
    )

