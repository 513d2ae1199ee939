"""Ages and deadlines relative to a given moment, never to the clock of the machine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000, 86_400_000


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def millis_between(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def age_label(when: Column, as_of: Column) -> Column:
    """Short age; '' for no date, a future date, or one more than 365 days back."""
    age = millis_between(when, as_of)
    hours = F.floor(age / HOUR).cast("int")
    days = F.floor(age / DAY).cast("int")
    return (
        F.when(when.isNull() | (age < 0) | (age > 365 * DAY), "")
        .when(hours < 1, "just now")
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .when(days < 30, F.concat(F.floor(days / 7).cast("string"), F.lit("w ago")))
        .otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit("mo ago")))
    )


def sync_label(when: Column, as_of: Column) -> Column:
    """Age of the last load, in minutes, hours or days."""
    minutes = F.floor(millis_between(when, as_of) / 60_000).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    return (
        F.when(when.isNull(), "recently")
        .when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
    )


def posting_age(posted: Column, scraped: Column, as_of: Column) -> Column:
    """Posted age, else the scraped age marked as an estimate."""
    estimate = F.when(scraped.isNull(), "").otherwise(F.concat(F.lit("~"), age_label(scraped, as_of)))
    return F.coalesce(F.nullif(age_label(posted, as_of), F.lit("")), estimate)


def is_new(posted: Column, scraped: Column, as_of: Column) -> Column:
    return F.coalesce(millis_between(F.coalesce(posted, scraped), as_of) < DAY, F.lit(False))


def deadline_urgent(deadline: Column, as_of: Column) -> Column:
    left = millis_between(as_of, deadline)
    return F.coalesce((left < 7 * DAY) & (left > 0), F.lit(False))


def deadline_past(deadline: Column, as_of: Column) -> Column:
    return F.coalesce(millis_between(as_of, deadline) < 0, F.lit(False))


def whole_days(start: Column, end: Column) -> Column:
    """Whole days from start to end, cut towards zero."""
    return (millis_between(start, end) / DAY).cast("long")
