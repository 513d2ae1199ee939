import json

from hirespan.functions import records


def responses(spark, *items):
    rows = [(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(items)]
    return spark.createDataFrame(rows, "id int, response string")


def test_analyses(spark):
    full = {
        "overall_score": "72", "ats_score": 140, "ats_issues": ["a", None, 3, {"x": 1}, [1], "[b] c"], "strengths": "no list",
        "section_scores": {"skills": 55.9, "odd": "x", "low": -3},
        "bullet_feedback": [{"original": "o", "score": 12}, {}],
        "recruiter_take": [{"section": "s", "grade": "A", "red_flags": ["r"]}],
        "ats_parsed_sections": {"name": "N", "skills": ["x", None, {"y": 1}, 2], "when": {"from": 1}, "none": None, "years": 3, "empty": []},
        "summary_verdict": None,
    }
    read, bad = records.parse_analyses(responses(spark, full, "```json\n{}\n```", "", None, '{"overall_score": 9', {"overall_score": True}))
    rows = {r.id: r for r in read.collect()}
    first = rows[0]
    assert (first.overall_score, first.ats_score, first.ats_issues) == (72, 100, ["a", "null", "3", "", "", "[b] c"])
    assert first.strengths == [] and first.section_scores == {"skills": 55, "odd": 50, "low": 0}
    assert [tuple(b) for b in first.bullet_feedback] == [("o", 12, "", ""), ("", 50, "", "")]
    assert [tuple(t) for t in first.recruiter_take] == [("s", "A", "", ["r"])]
    assert first.summary_verdict == "Analysis complete."
    assert {name: tuple(value) for name, value in first.ats_parsed_sections.items()} == {
        "name": ("N", None), "skills": (None, ["x", "null", "", "2"]), "when": ("", None), "none": ("", None),
        "years": ("3", None), "empty": (None, []),
    }
    assert rows[1].ats_parsed_sections is None
    for number in (1, 2, 3):
        assert (rows[number].overall_score, rows[number].ats_score, rows[number].bullet_feedback) == (50, 50, [])
    assert rows[5].overall_score == 1
    assert [(r.id, r.reason) for r in bad.collect()] == [(4, "unreadable response")]


def test_sections_and_verdicts_of_odd_shapes(spark):
    odd = [{"ats_parsed_sections": shape, "summary_verdict": verdict} for shape, verdict in [([1], ["x"]), ("text", {"a": 1}), (None, "[as it is]"), ({}, 7)]]
    found = records.parse_analyses(responses(spark, *odd))[0].orderBy("id").collect()
    assert [(r.ats_parsed_sections, r.summary_verdict) for r in found] == [(None, ""), (None, ""), (None, "[as it is]"), ({}, "7")]


def test_fits(spark):
    read, bad = records.parse_fits(responses(spark, {"fit_score": -4, "matched_skills": ["go"]}, "not json"))
    row = read.first()
    assert (row.fit_score, row.matched_skills, row.missing_skills, row.fit_summary) == (0, ["go"], [], "Analysis complete.")
    assert bad.count() == 1


def test_profiles(spark):
    good = {"skills": ["Go", 1], "yearsExperience": 2.9, "educationLevel": "PHD"}
    read, bad = records.parse_profiles(responses(spark, good, "```{}```", "oops {", {"yearsExperience": "some"}, None))
    rows = {r.id: (r.skills, r.years_experience, r.education_level, r.status) for r in read.collect()}
    assert rows == {
        0: (["Go", "1"], 2, "PHD", "PARSED"), 1: ([], None, None, "PARSED"), 2: ([], None, None, "PARSED"),
        3: ([], 0, None, "PARSED"), 4: ([], None, None, "PARSED"),
    }
    assert [r.id for r in bad.collect()] == [2]


def test_roasts(spark):
    read, bad = records.parse_roasts(responses(spark, {"brutal_roast_text": "hm", "missing_dependencies": ["x"], "top_dog_rank": 140}, {}, "```{}```"))
    rows = {r.id: r for r in read.collect()}
    assert (rows[0].roast_text, rows[0].missing_dependencies, rows[0].top_dog_rank, rows[0].tier_name) == ("hm", ["x"], 100, "ALPHA_DOG")
    assert (rows[1].top_dog_rank, rows[1].tier_name) == (50, "HOUSE_TRAINED") and rows[1].roast_text == records.DEFAULT_ROAST
    assert [r.id for r in bad.collect()] == [2]
