"""Match scores, tiers, bands and the ghost score as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirespan.functions.text import _trim_control, normal_skills

# Weights of the match score, in the order they are added.
REQUIRED_WEIGHT, PREFERRED_WEIGHT, EXPERIENCE_WEIGHT, EDUCATION_WEIGHT = 60.0, 15.0, 15.0, 10.0

# Lowest rank of each tier, best first.
TIERS = [
    (90, "ALPHA_DOG"),
    (75, "GOOD_BOY"),
    (60, "FETCH_PLAYER"),
    (40, "HOUSE_TRAINED"),
    (20, "LOST_PUPPY"),
    (0, "POUND_CANDIDATE"),
]
PROFILE_TIERS = [
    (90, "ALPHA DOG"),
    (75, "GOOD BOY"),
    (60, "FETCH PLAYER"),
    (40, "HOUSE TRAINED"),
    (0, "LOST PUPPY"),
]
PERCENTILE_LABELS = [(80, "Top candidate"), (60, "Above average"), (40, "Average"), (0, "Below average")]
PERCENTILE_COLOURS = [(70, "#10B981"), (40, "#F59E0B"), (0, "#EF4444")]

# Days a posting may stay open before the day part of the ghost score is full.
FULL_DAYS, PART_WEIGHT = 120.0, 50.0

DEFAULT_LEVEL, DEFAULT_ROLE = "INTERN", "Software Engineer"


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("int")


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), value))


def ladder(value: Column, steps: list[tuple[int, str]]) -> Column:
    """The name of the first step whose lower limit the value reaches; the last name otherwise."""
    chosen = F.when(value >= steps[0][0], steps[0][1])
    for limit, name in steps[1:-1]:
        chosen = chosen.when(value >= limit, name)
    return F.when(value.isNotNull(), chosen.otherwise(steps[-1][1]))


def wanted_skills(wanted: Column) -> Column:
    """Normal form of a list of wanted skills; null if nothing is wanted."""
    return F.when(F.size(wanted) > 0, normal_skills(wanted))


def coverage(have: Column, need: Column) -> Column:
    """Share of the needed skills at hand, from normal forms; nothing wanted gives 1.

    A list of blanks only has no share: the result is NaN, and the score below becomes 0.
    """
    share = F.size(F.array_intersect(need, have)) / F.greatest(F.size(need), F.lit(1))
    return F.when(need.isNull(), F.lit(1.0)).when(F.size(need) == 0, F.lit(float("nan"))).otherwise(share)


def experience_alignment(have: Column, need: Column) -> Column:
    ratio = F.least(F.lit(1.0), have / F.greatest(need, F.lit(1)))
    return (
        F.when(need.isNull() | (need <= 0), F.lit(1.0))
        .when(have.isNull() | (have < 0), F.lit(0.0))
        .otherwise(ratio)
    )


def _blank(text: Column) -> Column:
    return text.isNull() | (_trim_control(text) == "")


def education_alignment(have: Column, need: Column) -> Column:
    same = F.lower(_trim_control(have)) == F.lower(_trim_control(need))
    return (
        F.when(_blank(need), F.lit(1.0))
        .when(_blank(have), F.lit(0.0))
        .when(same, F.lit(1.0))
        .otherwise(F.lit(0.5))
    )


def match_score(required: Column, preferred: Column, experience: Column, education: Column) -> Column:
    """Weighted score 0..100 of the four parts, added in this order."""
    total = (
        required * REQUIRED_WEIGHT
        + preferred * PREFERRED_WEIGHT
        + experience * EXPERIENCE_WEIGHT
        + education * EDUCATION_WEIGHT
    )
    return F.when(F.isnan(total), F.lit(0)).otherwise(F.floor(F.nanvl(total, F.lit(0.0)) + 0.5).cast("int"))


def rank_tier(rank: Column) -> Column:
    return ladder(clamp(rank), TIERS)


def profile_tier(score: Column) -> Column:
    return ladder(score, PROFILE_TIERS)


def percentile_label(percentile: Column) -> Column:
    return ladder(percentile, PERCENTILE_LABELS)


def percentile_colour(percentile: Column) -> Column:
    return ladder(percentile, PERCENTILE_COLOURS)


def ghost_score(average_days: Column, reports: Column, jobs: Column) -> Column:
    days = F.least(F.lit(1.0), average_days / FULL_DAYS) * PART_WEIGHT
    share = F.least(F.lit(1.0), reports.cast("double") / F.greatest(jobs, F.lit(1))) * PART_WEIGHT
    total = F.floor(F.least(F.lit(100.0), days + share) + 0.5).cast("int")
    return F.when(jobs == 0, F.lit(0)).otherwise(total)


def ghost_risk(score: Column) -> Column:
    return F.when(score > 70, "HIGH").when(score > 40, "MODERATE").otherwise("LOW")


def level_or_default(level: Column) -> Column:
    return F.when(_blank(level), F.lit(DEFAULT_LEVEL)).otherwise(F.upper(level))


def role_or_default(role: Column) -> Column:
    return F.when(_blank(role), F.lit(DEFAULT_ROLE)).otherwise(_trim_control(role))
