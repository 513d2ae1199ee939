import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hirespan.functions import ages
from hirespan.operators import applications as apps
from hirespan.operators import feed, profiles, tables

NOW = "2024-06-01 00:00:00"
TEXTS = ["source", "source_job_id", "source_url", "title", "company", "location", "employment_type", "description_text"]
BATCH = ", ".join(f"{c} string" for c in TEXTS) + (
    ", minimum_years_experience int, education_level string, posted_at timestamp, scraped_at timestamp, arrival int"
)
TARGET = (
    "job_id string, source string, source_job_id string, source_url string, title string, company string, location string, "
    "employment_type string, description_text string, description_hash string, status string, minimum_years_experience int, "
    "education_level string, posted_at timestamp, scraped_at timestamp, created_at timestamp, updated_at timestamp"
)


def day(number):
    return dt.datetime(2024, 1, number) if number else None


def seen(arrival, url, key=None, title="t", posted=None, scraped=10, source="s", years=None):
    return (source, key, url, title, "c", "l", "e", f"text {title}", years, None, day(posted), day(scraped), arrival)


def stored(url, key=None, status="ACTIVE", posted=None, title="old", source="s"):
    return ("id-" + url, source, key, url, title, "c", "l", "e", "old text", "old hash", status, 3, "PHD", day(posted), day(2), day(1), day(2))


def upsert(spark, target, batch):
    merged, rejects = tables.upsert_jobs(spark.createDataFrame(target, TARGET), spark.createDataFrame(batch, BATCH), ages.moment(NOW))
    return {r.source_url: r for r in merged.collect()}, sorted(r.source_url for r in rejects.collect())


def test_new_row(spark):
    rows, rejects = upsert(spark, [], [seen(1, "u", "k", posted=3)])
    row = rows["u"]
    assert rejects == [] and row.job_id == hashlib.sha256(b"u").hexdigest()
    assert (row.status, row.posted_at, row.scraped_at) == ("ACTIVE", day(3), day(10))
    assert row.description_hash == hashlib.sha256(b"text t").hexdigest()
    assert row.created_at == row.updated_at == dt.datetime(2024, 6, 1)


def test_known_row_is_refreshed_and_reopened(spark):
    rows, _ = upsert(spark, [stored("u", "k", status="CLOSED"), stored("v", posted=5)], [seen(1, "u", "other", posted=3, years=9), seen(2, "v", posted=1)])
    row = rows["u"]
    assert (row.job_id, row.source_job_id, row.minimum_years_experience, row.education_level) == ("id-u", "k", 3, "PHD")
    assert (row.status, row.title, row.posted_at, row.created_at) == ("ACTIVE", "t", day(3), day(1))
    assert rows["v"].posted_at == day(5)


def test_untouched_row_stays(spark):
    rows, _ = upsert(spark, [stored("u", status="CLOSED")], [seen(1, "v")])
    assert tuple(rows["u"]) == stored("u", status="CLOSED") and set(rows) == {"u", "v"}


def test_two_arrivals_in_one_batch(spark):
    rows, _ = upsert(spark, [], [seen(2, "u", "k2", title="second", scraped=11), seen(1, "u", "k1", title="first", scraped=10, posted=4), seen(3, "u", "k3", title="third", scraped=11, posted=2)])
    row = rows["u"]
    assert (row.title, row.source_job_id, row.posted_at, row.scraped_at) == ("third", "k1", day(4), day(11))


def test_source_key_of_another_url_is_rejected(spark):
    batch = [seen(1, "new", "k"), seen(2, "first", "x"), seen(3, "later", "x"), seen(4, "none1", ""), seen(5, "none2", ""), seen(6, "elsewhere", "k", source="z")]
    rows, rejects = upsert(spark, [stored("u", "k")], batch)
    assert rejects == ["later", "new"]
    assert set(rows) == {"u", "first", "none1", "none2", "elsewhere"}
    assert rows["none1"].source_job_id is None


def test_row_without_url_is_rejected(spark):
    frame = spark.createDataFrame([seen(1, None, "k"), seen(2, "u", "k")], BATCH)
    merged, rejects = tables.upsert_jobs(spark.createDataFrame([], TARGET), frame, ages.moment(NOW))
    assert [r.source_url for r in merged.collect()] == ["u"]
    assert [(r.source_url, r.reason) for r in rejects.collect()] == [(None, "url is missing")]


def replay(target, batch):
    """The table after one statement per row, in order of arrival."""
    table = {row[3]: dict(zip([c.split()[0] for c in TARGET.split(", ")], row)) for row in target}
    rejected = set()
    for row in sorted(batch, key=lambda r: (r[11], r[12])):
        new = dict(zip([c.split()[0] for c in BATCH.split(", ")], row))
        url, key = new["source_url"], (new["source"], new["source_job_id"])
        old = table.get(url)
        if old is None and (url in rejected or (key[1] and any((o["source"], o["source_job_id"]) == key for o in table.values()))):
            rejected.add(url)
        elif old is None:
            table[url] = {**new, "job_id": "new"}
        else:
            old.update({c: new[c] for c in ("title", "company", "location", "description_text", "scraped_at")}, status="ACTIVE")
            old["posted_at"] = old["posted_at"] or new["posted_at"]
    return {u: (r["title"], r["source_job_id"] or None, r["posted_at"], r["scraped_at"], r["source"]) for u, r in table.items()}, sorted(rejected)


@pytest.mark.parametrize("seed", range(4))
def test_upsert_equals_replay(spark, seed):
    draw = random.Random(seed)
    target = [stored(f"u{i}", f"k{i}", posted=draw.choice([None, 5])) for i in range(6)]
    batch = [
        # A URL keeps its key within the batch.
        seen(n, f"u{u}", f"k{u % 7}", title=f"t{n}", posted=draw.choice([None, 1, 2, 3]), scraped=draw.randrange(10, 13))
        for n, u in enumerate(draw.choices(range(12), k=40))
    ]
    rows, rejects = upsert(spark, target, batch)
    expected, expected_rejects = replay(target, batch)
    assert {u: (r.title, r.source_job_id, r.posted_at, r.scraped_at, r.source) for u, r in rows.items()} == expected
    assert rejects == expected_rejects


def test_upsert_twice_is_upsert_once(spark):
    batch = [seen(n, f"u{n % 5}", f"k{n % 5}", title=f"t{n}", posted=n % 4 or None) for n in range(12)]
    frame = spark.createDataFrame(batch, BATCH)
    once, _ = tables.upsert_jobs(spark.createDataFrame([stored("u1", "k1")], TARGET), frame, ages.moment(NOW))
    twice, rejects = tables.upsert_jobs(once, frame, ages.moment(NOW))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and rejects.count() == 0


def test_upsert_latest(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, None, 1)], "k int, v string, n int")
    assert sorted(map(tuple, tables.upsert_latest(target, batch, ["k"], ["n"]).collect())) == [(1, "a"), (2, "y"), (3, None)]


def test_close_stale(spark):
    target = spark.createDataFrame([(1, "ACTIVE", "2024-05-01 23:59:59"), (2, "ACTIVE", "2024-05-02 00:00:00"), (3, "SCRAPED", "2020-01-01 00:00:00")], "job_id int, status string, s string")
    jobs = target.select("job_id", "status", F.col("s").cast("timestamp").alias("scraped_at"))
    assert {r.job_id: r.status for r in tables.close_stale(jobs, ages.moment(NOW)).collect()} == {1: "CLOSED", 2: "ACTIVE", 3: "SCRAPED"}


def test_close_dead(spark):
    jobs = spark.createDataFrame([(i, "ACTIVE") for i in range(1, 8)] + [(8, "SCRAPED")], "job_id int, status string")
    probes = spark.createDataFrame(
        [(1, 1, 200, None, 1), (2, 2, 404, None, 1), (3, 3, 410, None, 1), (4, 4, 500, None, 1), (5, 5, None, "timed out", 1),
         (6, 6, 404, None, 1), (7, 6, 200, None, 2), (8, 8, 404, None, 1)],
        "probe_id int, job_id int, status_code int, error string, checked_at int",
    )
    found = {r.job_id: r.status for r in tables.close_dead(jobs, probes).collect()}
    assert found == {1: "ACTIVE", 2: "CLOSED", 3: "CLOSED", 4: "ACTIVE", 5: "ACTIVE", 6: "ACTIVE", 7: "ACTIVE", 8: "SCRAPED"}
    assert tuple(tables.probe_counters(jobs, probes).first()) == (7, 2, 1)


def test_delete_and_status(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2)], "user_id int, job_id int")
    assert [tuple(r) for r in tables.delete_rows(rows, rows.where("job_id = 2"), ["user_id", "job_id"]).collect()] == [(1, 1)]
    log = spark.createDataFrame([(1, "UPLOADED", 1, 1), (1, "PARSED", 2, 3), (1, "PROCESSING", 2, 2)], "k int, status string, ts int, event_id int")
    assert tables.latest_status(log, "k").first().status == "PARSED"


def test_users(spark):
    users = spark.createDataFrame([(" Known@X.com",)], "email string")
    logins = spark.createDataFrame(
        [("known@x.com", "K", 1), (" New@X.com ", " ", 2), ("new@x.com", "Named", 3), (None, "n", 4), ("  ", "n", 5), ("b@y.com", " Bo ", 6)],
        "email string, name string, login_id int",
    )
    rows = tables.find_or_create_users(users, logins).orderBy("email").collect()
    assert [(r.email, r.display_name, r.profile_visibility) for r in rows] == [("b@y.com", "Bo", "PRIVATE"), ("new@x.com", "new", "PRIVATE")]


def test_latest_and_best(spark):
    rows = spark.createDataFrame([(1, 10, 5, 1, None), (1, 10, 5, 2, "x"), (1, 11, 4, 3, "y"), (2, 1, 1, 4, "z")], "user_id int, overall_score int, analyzed_at int, analysis_id int, note string")
    best = profiles.best_analyses(rows).orderBy("user_id").collect()
    assert [(r.analysis_id, r.note) for r in best] == [(3, "y"), (4, "z")]
    users = spark.createDataFrame([(1, "A", "PUBLIC"), (2, "B", "PRIVATE"), (3, "C", "PUBLIC")], "user_id int, display_name string, profile_visibility string")
    assert sorted(r.user_id for r in profiles.public_profiles(users, profiles.best_analyses(rows)).collect()) == [1, 3]
    assert profiles.public_profiles(users, profiles.best_analyses(rows), only_public=False).count() == 3


def test_greatest_keeps_rows_with_null_in_order(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, None, 2)], "user_id int, at int, id int")
    assert [tuple(r) for r in profiles.greatest_per_key(rows, ["user_id"], ["at", "id"]).collect()] == [(1, None, 2)]


def test_roasts_without_job(spark):
    roasts = spark.createDataFrame([(1, 1, None, 95, 1), (2, 1, 7, 10, 2), (3, 1, 8, 50, 3)], "roast_id int, user_id int, job_id int, top_dog_rank int, roasted_at int")
    jobs = spark.createDataFrame([(7, "T", "C")], "job_id int, title string, company string")
    assert [(r.job_title, r.company, r.tier_name) for r in apps.roast_list(roasts, jobs).orderBy("roast_id").collect()] == [
        ("General Roast", "—", "ALPHA_DOG"), ("T", "C", "POUND_CANDIDATE"), ("General Roast", "—", "HOUSE_TRAINED"),
    ]


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [(i, f"Role {i}", "Acme" if i % 2 else "B_x", "Remote" if i % 3 else None, "ACTIVE" if i != 4 else "CLOSED", f"2024-01-{i:02d} 00:00:00", "go and sql") for i in range(1, 10)]
    frame = spark.createDataFrame(rows, "job_id int, title string, company string, location string, status string, p string, description_text string")
    return frame.select("*", F.col("p").cast("timestamp").alias("posted_at"), F.lit(None).cast("timestamp").alias("scraped_at"))


def ids(frame):
    return [r.job_id for r in frame.collect()]


def test_feed(spark, jobs):
    assert ids(feed.feed_page(jobs, 0, 3)) == [9, 8, 7] and ids(feed.feed_page(jobs, 1, 3)) == [6, 5, 3] and ids(feed.feed_page(jobs, -1, 3)) == [9, 8, 7]
    assert len(ids(feed.feed_page(jobs, 0, 0))) == 8
    assert set(ids(feed.filter_feed(jobs, company="b_X"))) == {2, 6, 8} and set(ids(feed.filter_feed(jobs, company="b%x", remote=True))) == {2, 8}
    assert set(ids(feed.filter_feed(jobs, location="REM", remote=False))) == {1, 2, 5, 7, 8} and ids(feed.filter_feed(jobs, search="role 9")) == [9]
    assert set(ids(feed.filter_feed(jobs, search="cme"))) == {1, 3, 5, 7, 9}
    summary = feed.feed_summary(jobs, remote=True).first()
    assert (summary.total, summary.last_sync) == (5, dt.datetime(2024, 1, 9))
    profile = spark.createDataFrame([(["Go", "java", "sql "],)], "skills array<string>")
    page = feed.feed_page(jobs, 0, 3, profile).collect()
    assert [(r.job_id, r.match_percentage) for r in page] == [(9, 67), (8, 67), (7, 67)]
    nobody = spark.createDataFrame([], "skills array<string>")
    assert feed.feed_page(jobs, 0, 1, nobody).first().match_percentage == 0


def test_sort_keys_are_checked(jobs):
    with pytest.raises(ValueError, match="salary"):
        apps.sort_by(jobs, "salary", True)


def test_plan_reads_only_what_it_needs(spark, sf_dir):
    """Filters and columns reach the scan, and a page needs no full sort."""
    from hirespan.plans import catalog

    plan = catalog.QUERIES["feed_page_o1_o2"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    scan = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_orderstatus", "status")
    plan = feed.active_count(scan)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,ACTIVE)]" in plan and "ReadSchema: struct<o_orderstatus:string>" in plan
