import math

import pytest
from pyspark.sql import functions as F

from hirespan.functions import ages, scoring
from hirespan.operators.applications import score_applications
from hirespan.operators.ghost import ghost_scores
from hirespan.operators.percentile import percent_half_up, percentile_of


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def array(*items):
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


@pytest.mark.parametrize(
    "have, wanted, expected",
    [
        (["go"], [], 1.0), (["go"], None, 1.0), (None, ["go"], 0.0), ([" GO "], ["go", "Go ", "sql"], 0.5), (["go"], [" ", ""], math.nan),
    ],
)
def test_coverage(spark, have, wanted, expected):
    frame = spark.createDataFrame([(have, wanted)], "h array<string>, w array<string>")
    found = frame.select(scoring.coverage(scoring.normal_skills(F.col("h")), scoring.wanted_skills(F.col("w")))).first()[0]
    assert found == expected or (math.isnan(found) and math.isnan(expected))


@pytest.mark.parametrize(
    "have, need, expected",
    [(3, None, 1.0), (None, 0, 1.0), (None, -1, 1.0), (None, 2, 0.0), (-1, 2, 0.0), (1, 2, 0.5), (2, 2, 1.0), (9, 2, 1.0), (0, 2, 0.0)],
)
def test_experience(spark, have, need, expected):
    assert one(spark, scoring.experience_alignment(F.lit(have).cast("int"), F.lit(need).cast("int"))) == expected


@pytest.mark.parametrize(
    "have, need, expected",
    [("PHD", None, 1.0), ("PHD", " ", 1.0), (None, "PHD", 0.0), (" ", "PHD", 0.0), (" phd", "PHD ", 1.0), ("MASTERS", "PHD", 0.5)],
)
def test_education(spark, have, need, expected):
    assert one(spark, scoring.education_alignment(F.lit(have).cast("string"), F.lit(need).cast("string"))) == expected


@pytest.mark.parametrize("parts, expected", [((1, 1, 1, 1), 100), ((0, 0, 0, 0), 0), ((0.5, 0.5, 0, 0), 38), ((1 / 3, 0, 0, 0.5), 25)])
def test_match_score(spark, parts, expected):
    assert one(spark, scoring.match_score(*[F.lit(float(p)) for p in parts])) == expected


def test_undefined_part_gives_zero(spark):
    assert one(spark, scoring.match_score(F.lit(1.0), F.lit(float("nan")), F.lit(1.0), F.lit(1.0))) == 0


def test_score_applications_needs_both_lists(spark):
    applications = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 1, 2)], "application_id int, job_id int, resume_id int")
    profiles = spark.createDataFrame([(1, ["go"], 2, "PHD")], "resume_id int, skills array<string>, years_experience int, education_level string")
    needs = spark.createDataFrame([(1, ["go", "sql"], None)], "job_id int, required_skills array<string>, preferred_skills array<string>")
    jobs = spark.createDataFrame([(1, 4, "PHD"), (2, None, None)], "job_id int, minimum_years_experience int, education_level string")
    for options in ({}, {"parts": 4, "floor": 0}):
        rows = {r.application_id: r for r in score_applications(applications, profiles, needs, jobs, **options).collect()}
        # 0.5 * 60 + 15 + 0.5 * 15 + 10 = 62.5, rounded up
        assert (rows[1].is_scored, rows[1].match_score, rows[1].required_coverage) == (True, 63, 0.5)
        assert [(rows[i].is_scored, rows[i].match_score) for i in (2, 3)] == [(False, None), (False, None)]


@pytest.mark.parametrize(
    "rank, tier",
    [
        (-5, "POUND_CANDIDATE"), (0, "POUND_CANDIDATE"), (19, "POUND_CANDIDATE"), (20, "LOST_PUPPY"), (39, "LOST_PUPPY"),
        (40, "HOUSE_TRAINED"), (59, "HOUSE_TRAINED"), (60, "FETCH_PLAYER"), (74, "FETCH_PLAYER"), (75, "GOOD_BOY"),
        (89, "GOOD_BOY"), (90, "ALPHA_DOG"), (100, "ALPHA_DOG"), (140, "ALPHA_DOG"),
    ],
)
def test_tiers(spark, rank, tier):
    assert one(spark, scoring.rank_tier(F.lit(rank))) == tier


def test_bands(spark):
    assert [one(spark, scoring.ghost_risk(F.lit(s))) for s in (40, 41, 70, 71)] == ["LOW", "MODERATE", "MODERATE", "HIGH"]
    assert [one(spark, scoring.percentile_label(F.lit(s))) for s in (39, 40, 60, 80)] == ["Below average", "Average", "Above average", "Top candidate"]
    assert one(spark, scoring.level_or_default(F.lit(" "))) == "INTERN" and one(spark, scoring.level_or_default(F.lit("new_grad"))) == "NEW_GRAD"
    assert one(spark, scoring.role_or_default(F.lit(None).cast("string"))) == "Software Engineer"


@pytest.mark.parametrize("part, whole, expected", [(0, 4, 0), (1, 8, 13), (1, 3, 33), (2, 3, 67), (4, 4, 100), (0, 0, None)])
def test_percent(spark, part, whole, expected):
    assert one(spark, percent_half_up(F.lit(part).cast("long"), F.lit(whole).cast("long"))) == expected


def test_empty_pool_gives_fifty(spark):
    scores = spark.createDataFrame([(1, 7, 40), (2, 7, 60)], "application_id int, job_id int, match_score int")
    probes = spark.createDataFrame([(7, 50), (7, 10), (8, 50)], "job_id int, probe_score int")
    assert {(r.job_id, r.probe_score): r.percentile for r in percentile_of(scores, probes).collect()} == {(7, 50): 50, (7, 10): 0, (8, 50): 50}


def test_ghost_scores(spark):
    jobs = spark.createDataFrame(
        [("A", "2023-09-03 00:00:00"), ("a", None), ("B", None), ("C", "2024-01-11 00:00:00"), ("D", "2023-11-02 00:00:00")],
        "company string, posted_at string",
    ).withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    reports = spark.createDataFrame([("a",), ("B",), ("b",), ("z",)], "company string")
    rows = {r.company_key: r for r in ghost_scores(jobs, reports, ages.moment("2024-01-01 00:00:00")).collect()}
    assert {k: (r.ghost_score, r.avg_days_open, r.ghost_reports, r.total_jobs) for k, r in rows.items()} == {
        "a": (75, 120, 1, 2), "b": (50, 0, 2, 1), "c": (-4, -10, 0, 1), "d": (25, 60, 0, 1), "z": (0, 0, 1, 0),
    }


@pytest.mark.parametrize(
    "hours, label",
    [(-1, ""), (59 / 60, "just now"), (1, "1h ago"), (23, "23h ago"), (24, "1d ago"), (6 * 24, "6d ago"), (7 * 24, "1w ago"),
     (29 * 24, "4w ago"), (30 * 24, "1mo ago"), (365 * 24, "12mo ago"), (366 * 24, "")],
)
def test_age_label(spark, hours, label):
    now = ages.moment("2024-06-01 00:00:00")
    assert one(spark, ages.age_label(F.timestamp_millis(F.unix_millis(now) - F.lit(int(hours * 3_600_000))), now)) == label


def test_age_fallback_and_deadlines(spark):
    now, none = ages.moment("2024-06-01 00:00:00"), F.lit(None).cast("timestamp")
    assert one(spark, ages.posting_age(none, ages.moment("2024-05-30 00:00:00"), now)) == "~2d ago"
    assert one(spark, ages.posting_age(none, none, now)) == "" and one(spark, ages.age_label(none, now)) == ""
    assert one(spark, ages.is_new(none, ages.moment("2024-05-31 01:00:00"), now)) and not one(spark, ages.is_new(none, none, now))
    flags = [(one(spark, ages.deadline_urgent(ages.moment(d), now)), one(spark, ages.deadline_past(ages.moment(d), now)))
             for d in ("2024-05-31 00:00:00", "2024-06-07 23:00:00", "2024-06-08 00:00:00")]
    assert flags == [(False, True), (True, False), (False, False)]
    assert [one(spark, ages.whole_days(ages.moment(a), now)) for a in ("2024-05-30 01:00:00", "2024-06-02 23:00:00")] == [1, -1]
