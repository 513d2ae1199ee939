"""What is worked out once, written and thrown away: the volume that lists, scores and streams move."""

import datetime

import pytest
from pyspark.sql import functions as F

from hirespan.functions import ages, text
from hirespan.operators import applications, percentile, skew
from hirespan.operators.skills import pair_match
from hirespan.plans import bindings, candidates, streams
from hirespan.sources.buckets import Buckets
from hirespan.sources.store import versions
from hirespan.streaming import ingest


@pytest.fixture
def load(spark, tmp_path):
    day = datetime.datetime(2000, 1, 1)
    orders = [(k, k % 7, day + datetime.timedelta(days=k), "5-LOW", "F", 10.5 * k) for k in range(40)]
    lines = [(k % 40, k % 11, 1 + k % 7, 7.25 * k, day) for k in range(200)] + [(1, None, 1, 3.0, day), (None, 2, 1, 3.0, day)]
    spark.createDataFrame(
        orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string, o_orderstatus string, o_totalprice double"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    part = [(k, f"Gear bolt {k}", "Brand#1", "SMALL", k) for k in range(9)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, f"N{k}") for k in range(25)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    return bindings.tables(spark, str(tmp_path))


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_applications_and_scores_from_one_grouping(load):
    rows, scores = bindings.applied(load)
    for got, view in ((rows, "v_applications"), (scores, "v_scores")):
        want = load(view)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_lists_and_scores_group_lines_once(load):
    for frame in (candidates._listed(load), applications.score_applications(*candidates._score_inputs(load))):
        assert "Aggregate [o_custkey" not in plan_of(frame)  # the grouped rows are read, not grouped again


def test_heavy_keys_can_be_counted_in_other_rows(spark):
    rows = spark.createDataFrame([(k, 1 if k < 90 else k) for k in range(100)], "id int, job_id int")
    names = spark.createDataFrame([(k, f"n{k}") for k in (1, 95)], "job_id int, name string")
    costly = rows.withColumn("wide", F.repeat(F.lit("x"), 9))
    joined = skew.salted_join(costly, names, ["job_id"], ["id"], "left", parts=8, counted=rows)
    assert {(r.id, r.name) for r in joined.collect()} == {(k, "n1" if k < 90 else "n95" if k == 95 else None) for k in range(100)}
    assert joined.count() == 100


def test_buckets_are_put_in_place_without_a_shuffle(spark, tmp_path, monkeypatch):
    table = Buckets(f"{tmp_path}/t", ["k"], "k int, v string", 4)
    for number in range(3):
        table.stage(spark.range(20).selectExpr("cast(id as int) k", f"'{number}' v"), number)
        assert versions(spark, f"{tmp_path}/t/staged") == [number]
        with monkeypatch.context() as patch:
            patch.setattr("pyspark.sql.classic.dataframe.DataFrame.repartition", lambda *_: pytest.fail("shuffled"))
            table.put(spark, number)
    assert sorted((r.k, r.v) for r in table.read(spark).collect()) == [(k, "2") for k in range(20)]


def test_pair_match_looks_once_and_as_spark_does(spark):
    profiles = spark.createDataFrame([(1, ["É", "b c", "zz"]), (2, ["x"]), (3, [])], "user_id int, skills array<string>")
    jobs = spark.createDataFrame([(10, "aÉb C"), (11, None), (12, "")], "job_id int, description_text string")
    pairs = spark.createDataFrame([(u, j) for u in (1, 2, 3) for j in (10, 11, 12)], "user_id int, job_id int")
    matched = pair_match(pairs, profiles, jobs)
    assert {(r.user_id, r.job_id, r.match_percentage) for r in matched.collect() if r.match_percentage} == {(1, 10, 67)}
    assert matched.count() == 9
    assert "contains(" not in plan_of(matched).lower()


def test_listing_needs_no_join_on_applications(load, spark):
    got = candidates._listed(load)
    joins = [line for line in plan_of(got).splitlines() if "Join" in line]
    assert joins and not any("application_id" in line for line in joins)
    rows, scores = bindings.applied(load)
    want = applications.application_list(rows, load("v_jobs"), load("v_resumes"), percentile.snapshot_percentile(scores))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count()


def test_listing_with_nulls_and_ids_that_meet(load, spark):
    day = datetime.datetime(2000, 1, 1)
    kind = "application_id long, user_id long, job_id long, resume_id long, status string, applied_at timestamp, match_score int"
    rows = spark.createDataFrame(
        [(1, 1, 1, 1, "APPLIED", day, 5), (None, None, 1, 2, "APPLIED", day, 9), (3, 3, 1, 3, "APPLIED", day, None), (4, 4, 2, 4, "APPLIED", day, None)],
        kind,
    )
    plain = rows.drop("match_score")
    scores = percentile.snapshot_percentile(rows)
    got = applications.application_list(rows, load("v_jobs"), load("v_resumes"))
    want = applications.application_list(plain, load("v_jobs"), load("v_resumes"), scores)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 4


@pytest.fixture
def hot_load(load, spark, tmp_path):
    """The same with most lines of one job, parts that come twice, and keys that are null."""
    lines, day = load("lineitem"), datetime.datetime(2000, 1, 1)
    hot = spark.createDataFrame([(k % 40, 3, 2, 1.0, day) for k in range(400)], lines.schema)
    lines.unionByName(hot).write.parquet(f"{tmp_path}/hot/lineitem.parquet")
    parts = load("part")
    twice = parts.where("p_partkey in (3, 5)").withColumn("p_size", F.col("p_size") + 2)
    parts.unionByName(twice).write.parquet(f"{tmp_path}/hot/part.parquet")
    orders = load("orders")
    nameless = orders.where("o_orderkey = 1").withColumn("o_custkey", F.lit(None).cast("long"))
    orders.unionByName(nameless).write.parquet(f"{tmp_path}/hot/orders.parquet")
    load("nation").write.parquet(f"{tmp_path}/hot/nation.parquet")
    return bindings.tables(spark, f"{tmp_path}/hot")


def test_scores_group_lines_by_the_partitions_of_their_job(hot_load, spark, monkeypatch):
    monkeypatch.setattr(candidates, "written", lambda *_: pytest.fail("written before it is scored"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = candidates.match_scores(hot_load)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in moved if "user_id#" in line or "custkey#" in line]
    # Lines go to their job once; the other side of the join goes there too.
    assert sorted(line.split("), ")[1].split(",")[0] for line in moved if "_salt#" in line) == ["ENSURE_REQUIREMENTS", "REPARTITION_BY_COL"]


@pytest.mark.parametrize("which", ["load", "hot_load"])
def test_scores_agree_with_those_of_the_view(request, which):
    tables = request.getfixturevalue(which)
    _, shares = bindings.dealt_applications(tables)
    assert [r.job_id for r in shares.collect()] == ([3] if which == "hot_load" else [])
    plain = tables("v_profiles").withColumn("skills", F.split("skills_text", ","))
    whole = applications.score_applications(tables("v_applications"), plain, *candidates._score_sides(tables)[1:])
    got = candidates.match_scores(tables)
    assert got.schema.simpleString() == whole.select(*got.columns).schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.select(*got.columns).collect())) and got.count()
    known = whole.where("is_scored").withColumn("scored_at", F.col("applied_at"))
    want = percentile.arrival_percentile(known.select("application_id", "user_id", "job_id", "match_score", "scored_at"))
    told = streams.score_recompute(tables)
    assert told.schema.simpleString() == want.schema.simpleString()
    if which == "load":  # ids there are unique, so the order of arrival is
        assert sorted(map(repr, told.collect())) == sorted(map(repr, want.collect()))
    assert told.count() == want.count() > 0


def test_total_is_counted_without_a_shuffle_by_key(spark):
    rows = spark.createDataFrame([(1, k) for k in range(9)] + [(2, 1)], "job_id int, id int")
    heavy = skew.heavy_keys(rows, ["job_id"], 2)
    assert [tuple(r) for r in heavy.collect()] == [(1, 9, 10)]
    assert plan_of(heavy).count("Aggregate [job_id") == 1
    assert skew.heavy_keys(rows.where("id > 99"), ["job_id"], 2).count() == 0


def test_packed_texts_come_back(spark):
    lists = [None, [], ["a"], ["a|b", "%7C", "~", "%", "%25~", "é c"], ["%257E"]]
    plain = [None, "", "%", "~|%7E", "MASTERS "]
    rows = spark.createDataFrame(list(zip(lists, plain, reversed(lists))), "a array<string>, t string, b array<string>")
    packed = text.packed_texts(text.packed_skills(F.col("a")), text.escaped(F.col("t")), text.packed_skills(F.col("b")))
    parts = rows.withColumn("p", text.unpacked_texts(packed))
    back = parts.select(
        text.unpacked_skills(F.get("p", F.lit(0))).alias("a"),
        text.unescaped(F.get("p", F.lit(1))).alias("t"),
        text.unpacked_skills(F.get("p", F.lit(2))).alias("b"),
    )
    assert [tuple(r) for r in back.collect()] == list(zip(lists, plain, reversed(lists)))


def test_texts_of_touched_jobs_are_not_shuffled_for_their_skills(spark, tmp_path, monkeypatch):
    seen = []
    profiles = ingest.requirement_profiles
    monkeypatch.setattr(ingest, "requirement_profiles", lambda rows: seen.append(plan_of(rows)) or profiles(rows))
    handle = ingest.ingest_batch(f"{tmp_path}/t", ages.moment("2024-06-01 00:00:00"), buckets=2)
    line = "| F | {} | B | [x](https://l.example/{}) |"
    for number, names in enumerate((["Go 1", "Go 2", "Go 3"], ["Rust 2"])):
        body = "\n".join(line.format(name, name[-1]) for name in names)
        handle(spark.createDataFrame([("listing", "", "", datetime.datetime(2024, 1, 1 + number), body)], ingest.LANDING_SCHEMA), number)
    assert len(seen) == 2 and not any("Join" in plan or "Exchange" in plan for plan in seen)
    found = ingest.present_requirements(spark, f"{tmp_path}/t", 2).collect()
    assert sorted(r.required_skills for r in found) == [["go"], ["go"], ["rust"]]
    assert "touched" not in ingest.present_jobs(spark, f"{tmp_path}/t", 2).columns
