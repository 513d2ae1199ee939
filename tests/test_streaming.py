"""Streams in several batches against the batch forms, and repeated batches."""

import datetime as dt
import json
import random
from types import SimpleNamespace

import pytest
from compare import differences, oracle_connection
from pyspark.sql import functions as F

from hirespan.functions import ages
from hirespan.operators.applications import score_applications
from hirespan.operators.percentile import arrival_percentile
from hirespan.plans import streams
from hirespan.plans.bindings import tables
from hirespan.plans.registry import ORACLES
from hirespan.session import shared_folder
from hirespan.sources.store import read_version, versions
from hirespan.streaming import feed, ingest, limits, runs, scores


def rows(frame):
    return sorted(map(str, frame.collect()))


def one_file_per_batch(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def land(frames, path):
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)


def test_shared_folder_follows_the_session(spark, tmp_path):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
    cluster = SimpleNamespace(conf={"spark.checkpoint.dir": f"{tmp_path}/"})
    assert shared_folder(cluster, "x").startswith(f"{tmp_path}/x-")


def in_order(spark, rows, files):
    """The rows, given in order of time, as frames of the files that land one after the other."""
    step = -(-rows.count() // files)
    listed = rows.collect()
    return [spark.createDataFrame(listed[k : k + step], rows.schema) for k in range(0, len(listed), step)]


@pytest.mark.parametrize("files", [1, 3, 7])
def test_feed_shows_each_posting_once_however_long_ago(spark, tmp_path, files):
    """Postings come again after a second, a day and a year."""
    at = [0, 1, 86_400, 366 * 86_400]
    moments = sorted((t + 10 * u, f"u{u}") for u in range(20) for t in at)
    frame = spark.createDataFrame([(u, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)) for t, u in moments] + [(None, None)], "source_url string, ts timestamp")
    land(in_order(spark, frame, files), f"{tmp_path}/in")
    shown = feed.new_postings(one_file_per_batch(spark, f"{tmp_path}/in", frame.schema), "source_url")
    runs.drain_to_table(shown, f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.source_url for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(f"u{u}" for u in range(20))


def test_rolling_feed(spark, tmp_path):
    frames = [spark.range(start, start + 15).select("id", (F.col("id") * 2).alias("at")) for start in (30, 0, 15)]
    land(frames, f"{tmp_path}/in")
    handle = feed.keep_newest(f"{tmp_path}/out", "at", "id")
    runs.drain_batches(one_file_per_batch(spark, f"{tmp_path}/in", frames[0].schema), f"{tmp_path}/state", handle)
    assert versions(spark, f"{tmp_path}/out") == [0, 1, 2]
    assert sorted(r.id for r in read_version(spark, f"{tmp_path}/out").collect()) == list(range(25, 45))
    handle(frames[2], 2)
    assert sorted(r.id for r in read_version(spark, f"{tmp_path}/out").collect()) == list(range(25, 45))


class Bucket:
    """Five attempts, filled up again whenever another minute has passed since the first one."""

    def __init__(self, now):
        self.filled, self.left = now, 5

    def take(self, now):
        while now - self.filled >= 60:
            self.filled, self.left = self.filled + 60, 5
        self.left, taken = max(self.left - 1, 0), self.left > 0
        return taken


def refused_by_buckets(attempts):
    """(client, start of the interval, attempts, refused) in seconds."""
    buckets, counts = {}, {}
    for client, at in sorted(attempts, key=lambda x: x[1]):
        bucket = buckets.setdefault(client, Bucket(at))
        taken = bucket.take(at)
        total, refused = counts.get((client, bucket.filled), (0, 0))
        counts[client, bucket.filled] = total + 1, refused + (not taken)
    return sorted((c, w, n, r) for (c, w), (n, r) in counts.items() if r)


@pytest.mark.parametrize("files", [1, 3, 7])
def test_limits_equal_a_plain_bucket(spark, tmp_path, files):
    rng = random.Random(files)
    attempts = sorted(((rng.choice("aaaaabc"), rng.randrange(0, 900) + rng.choice([0, 7200])) for _ in range(300)), key=lambda x: x[1])
    attempts += [("d", 8200 + s) for s in range(6)]  # an interval that is still open
    zero = dt.datetime(2024, 1, 1, 0, 0, 13)
    frame = spark.createDataFrame([(c, zero + dt.timedelta(seconds=s)) for c, s in attempts], "client string, ts timestamp")
    expected = [(c, zero + dt.timedelta(seconds=w), n, r) for c, w, n, r in refused_by_buckets(attempts)]
    assert expected and expected[-1][0] == "d"
    assert sorted(map(tuple, limits.attempts_over_limit(frame, "client", "ts").collect())) == expected
    land(in_order(spark, frame, files), f"{tmp_path}/in")
    handle = limits.attempts_batch(f"{tmp_path}/out", "client", "string", "ts", buckets=4)
    runs.drain_batches(one_file_per_batch(spark, f"{tmp_path}/in", frame.schema), f"{tmp_path}/state", handle)
    handle(in_order(spark, frame, files)[-1], files - 1)  # handed over twice
    found = limits.attempts_found(spark, f"{tmp_path}/out", "client", "string")
    assert sorted(map(tuple, found.collect())) == expected


def test_attempts_without_client_or_time_do_not_count(spark, tmp_path):
    frame = spark.createDataFrame([(None, dt.datetime(2024, 1, 1))] * 9 + [("a", None)] * 9, "client string, ts timestamp")
    assert limits.attempts_over_limit(frame, "client", "ts").collect() == []
    limits.attempts_batch(f"{tmp_path}/out", "client", "string", "ts")(frame, 0)
    assert limits.attempts_found(spark, f"{tmp_path}/out", "client", "string").collect() == []
    assert limits.attempts_found(spark, f"{tmp_path}/none", "client", "string").collect() == []


def board(url, title, text, fetched):
    body = {"jobs": [{"id": 1, "title": title, "absolute_url": url, "content": text, "updated_at": "2024-01-01T00:00:00Z"}]}
    return ("board", "Acme", "acme" + url.rsplit("/", 1)[1], fetched, json.dumps(body))


def test_ingest_in_batches(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    listing = "| Firm | Intern | Bonn | [x](https://l.example/1) |"
    batches = [
        [board("https://b.example/1", "Data Intern", "python required", day), ("listing", "", "", day, listing), ("board", "Bad", "bad", day, "{")],
        [board("https://b.example/1", "Data Intern II", "rust required", day), board("https://b.example/2", "Intern", "preferred: go", day)],
    ]
    land([spark.createDataFrame(b, ingest.LANDING_SCHEMA) for b in batches], f"{tmp_path}/in")
    handle = ingest.ingest_batch(f"{tmp_path}/t", ages.moment("2024-06-01 00:00:00"))
    runs.drain_batches(one_file_per_batch(spark, f"{tmp_path}/in", ingest.LANDING_SCHEMA), f"{tmp_path}/state", handle)
    jobs = ingest.present_jobs(spark, f"{tmp_path}/t")
    assert sorted((r.source_url, r.title) for r in jobs.collect()) == [
        ("https://b.example/1", "Data Intern II"), ("https://b.example/2", "Intern"), ("https://l.example/1", "Intern"),
    ]
    needs = ingest.present_requirements(spark, f"{tmp_path}/t").join(jobs, "job_id")
    assert sorted((r.source_url, r.required_skills, r.preferred_skills) for r in needs.collect()) == [
        ("https://b.example/1", ["rust"], []), ("https://b.example/2", [], ["go"]), ("https://l.example/1", [], []),
    ]
    assert [r.reason for r in read_version(spark, f"{tmp_path}/t/rejects", before=1).collect()] == ["unreadable response"]
    before = rows(jobs)
    handle(spark.createDataFrame(batches[1], ingest.LANDING_SCHEMA), 1)  # the same batch again
    assert rows(ingest.present_jobs(spark, f"{tmp_path}/t")) == before
    ingest.jobs_table(f"{tmp_path}/t").put(spark, 1)  # staged buckets put in place again
    assert rows(ingest.present_jobs(spark, f"{tmp_path}/t")) == before
    handle(spark.createDataFrame([board("https://b.example/2", "Intern again", "go", day)], ingest.LANDING_SCHEMA), 2)
    after = {r.source_url: r.title for r in ingest.present_jobs(spark, f"{tmp_path}/t").collect()}
    assert len(after) == 3 and after["https://b.example/2"] == "Intern again"


def test_profiles_in_batches(spark, tmp_path):
    schema = "resume_id int, response string, received_at int"
    frames = [spark.createDataFrame(b, schema) for b in ([(1, '{"skills":["a"]}', 1), (2, '{"skills":["b"]}', 1)], [(1, "broken {", 2), (3, '```{"yearsExperience":4}```', 1)])]
    land(frames, f"{tmp_path}/in")
    runs.drain_batches(one_file_per_batch(spark, f"{tmp_path}/in", schema), f"{tmp_path}/state", ingest.profile_batch(f"{tmp_path}/out", "int"))
    found = {r.resume_id: (r.skills, r.years_experience, r.status) for r in ingest.present_profiles(spark, f"{tmp_path}/out", "int").collect()}
    assert found == {1: ([], None, "PARSED"), 2: (["b"], None, "PARSED"), 3: ([], 4, "PARSED")}


def test_newest_text_of_a_batch_counts_whatever_its_hash(spark, tmp_path):
    """Many pairs of fetches in one batch: a choice by anything but time would be wrong for half of them."""
    early, late = dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 9)
    landed = []
    for k in range(20):
        landed.append(board(f"https://b.example/{k}", "Old Intern", f"old {k}", early))
        landed.append(board(f"https://b.example/{k}", "New Intern", f"new {k}", late))
    twice = "| F | First | B | [x](https://l.example/1) |\n| F | Second | B | [x](https://l.example/1) |"
    landed += [("listing", "", "", late, twice), ("listing", "", "", early, twice.replace("Second", "Older"))]
    frame = spark.createDataFrame(landed[::-1], ingest.LANDING_SCHEMA)
    ingest.ingest_batch(f"{tmp_path}/t", ages.moment("2024-06-01 00:00:00"), buckets=4)(frame, 0)
    titles = {r.source_url: r.title for r in ingest.present_jobs(spark, f"{tmp_path}/t", buckets=4).collect()}
    assert titles.pop("https://l.example/1") == "Second"
    assert len(titles) == 20 and set(titles.values()) == {"New Intern"}


def test_a_batch_reads_and_writes_its_own_buckets_only(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    handle = ingest.ingest_batch(f"{tmp_path}/t", ages.moment("2024-06-01 00:00:00"), buckets=32)

    def files():
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "t/jobs/table").rglob("*.parquet")}

    handle(spark.createDataFrame([board(f"https://b.example/{k}", "Intern", "go", day) for k in range(60)], ingest.LANDING_SCHEMA), 0)
    before = files()
    for number in (1, 2, 3):
        handle(spark.createDataFrame([board("https://b.example/7", f"Intern {number}", "go", day)], ingest.LANDING_SCHEMA), number)
        after = files()
        assert len(after) == len(before) and len(after.keys() - before.keys()) == 1
        before = after
    jobs = ingest.present_jobs(spark, f"{tmp_path}/t", buckets=32)
    assert jobs.count() == 60 and jobs.where("title = 'Intern 3'").count() == 1
    assert versions(spark, f"{tmp_path}/t/jobs/staged") == [3]


def test_a_source_key_stays_with_its_first_url(spark, tmp_path):
    """The clash is found although the two URLs lie in different buckets, and in a later batch."""
    day = dt.datetime(2024, 1, 1)
    handle = ingest.ingest_batch(f"{tmp_path}/t", ages.moment("2024-06-01 00:00:00"), buckets=16)

    def posting(url):
        kind, company, _, fetched, body = board(url, "Intern", "go", day)
        return (kind, company, "one", fetched, body)

    for number in range(3):
        handle(spark.createDataFrame([posting(f"https://b.example/{number}")], ingest.LANDING_SCHEMA), number)
    assert [r.source_url for r in ingest.present_jobs(spark, f"{tmp_path}/t", buckets=16).collect()] == ["https://b.example/0"]
    assert [r.source_url for r in read_version(spark, f"{tmp_path}/t/rejects").collect()] == ["https://b.example/2"]


@pytest.mark.parametrize("order", ["in time", "backwards", "mixed", "one batch"])
def test_scores_in_any_batches_equal_the_recompute(spark, tmp_path, order):
    def moment(n):
        return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)

    schema = "application_id int, user_id int, job_id int, resume_id int, applied_at timestamp"
    applications = [(n, n, n % 3 if n % 2 else 0, n % 11, moment(n // 2)) for n in range(120)]
    skills = ["a", "b", "c", "d", "e"]
    profiles = spark.createDataFrame([(r, skills[: r % 6], r, None) for r in range(10)], "resume_id int, skills array<string>, years_experience int, education_level string")
    needs = spark.createDataFrame([(j, skills, ["a", "z"]) for j in range(3)], "job_id int, required_skills array<string>, preferred_skills array<string>")
    jobs = spark.createDataFrame([(j, 5, None) for j in range(3)], "job_id int, minimum_years_experience int, education_level string")
    lists = {
        "in time": [applications[i : i + 40] for i in (0, 40, 80)],
        "backwards": [applications[i : i + 40] for i in (80, 40, 0)],
        "mixed": [applications[i::4] for i in (2, 0, 3, 1)] + [[]],
        "one batch": [applications],
    }[order]
    frames = [spark.createDataFrame(rows, schema) for rows in lists]
    handle = scores.score_batch(f"{tmp_path}/out", profiles, needs, jobs, buckets=2)
    for number, frame in enumerate(frames):
        handle(frame, number)
        if number == 1:
            handle(frame, number)  # a batch handed over twice
    whole = score_applications(spark.createDataFrame(applications, schema), profiles, needs, jobs).where("is_scored")
    recompute = arrival_percentile(whole.select("application_id", "user_id", "job_id", "match_score", F.col("applied_at").alias("scored_at")))
    told = scores.told(spark, f"{tmp_path}/out").select(*recompute.columns)
    assert rows(told) == rows(recompute)
    if order == "in time":  # nobody is told anew
        assert spark.read.parquet(f"{tmp_path}/out/ranked").count() == recompute.count()


@pytest.mark.parametrize("files", [1, 7])
def test_registered_streams_for_any_number_of_files(spark, files):
    """The registered queries use three files; their SQL knows nothing of files."""
    folder = "/root/testdata/sf0.001"
    connection, load = oracle_connection(folder), tables(spark, folder)
    for name, build in [
        ("new_posting_feed_st1", streams.new_posting_feed), ("rolling_feed_st3_o7", streams.rolling_feed),
        ("attempts_over_limit_stream_st5", streams.attempts_over_limit_stream),
    ]:
        assert [d for d in differences(build(load, files=files), connection, ORACLES[name]) if d != "no rows"] == [], name
