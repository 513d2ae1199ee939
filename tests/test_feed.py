"""Pages of the feed against a sort of all rows, and exports read back."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hirespan.functions import ages
from hirespan.operators import feed
from hirespan.sources import crawl, exports

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "job_id int, title string, company string, location string, employment_type string, posted_at timestamp, scraped_at timestamp, status string, source_url string"


@pytest.fixture(scope="module")
def jobs(spark):
    rows = []
    for k in range(230):
        posted = None if k % 9 == 0 else DAY + dt.timedelta(days=k % 5, seconds=k % 3)
        scraped = None if k % 18 == 0 else DAY + dt.timedelta(days=9)
        rows.append((k, f"Intern {k}", "Acme", "Remote" if k % 2 else "Bonn", "INTERNSHIP", posted, scraped, "CLOSED" if k % 7 == 0 else "ACTIVE", f"u{k}"))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("few", [1_000_000, 3])
def test_deep_pages(jobs, monkeypatch, few):
    """With few rows allowed the days are narrowed down to seconds; rows without any date come last."""
    monkeypatch.setattr(feed, "FEW_ROWS", few)
    active = feed.filter_feed(jobs)
    whole = [r.job_id for r in feed.feed_order(active).collect()]
    for page in (0, 1, 7, 19, 400):
        assert [r.job_id for r in feed.deep_page(active, page, 10).collect()] == whole[10 * page : 10 * page + 10], page
    assert [r.job_id for r in feed.deep_page(active, -3, 1000).collect()] == whole[:20]


def test_served_page(spark, jobs):
    page = feed.served_page(jobs, page=1, size=30, remote=True).orderBy("position").collect()
    every = feed.feed_order(feed.filter_feed(jobs, remote=True)).collect()
    assert [r.job_id for r in page] == [r.job_id for r in every[30:60]] and [r.position for r in page] == list(range(30))
    assert {(r.total, r.last_sync) for r in page} == {(len(every), DAY + dt.timedelta(days=9))}
    assert feed.served_page(jobs, page=99).collect() == []
    profile = spark.createDataFrame([(["Go", "rust"],)], "skills array<string>")
    described = jobs.withColumn("description_text", F.lit("golang"))
    assert {r.match_percentage for r in feed.served_page(described, size=3, profile=profile).collect()} == {50}


def test_details_of_active_jobs_only(spark, jobs):
    described = jobs.withColumn("description_text", F.lit("text"))
    wanted = spark.createDataFrame([(1,), (7,), (1,), (999,)], "job_id int")
    assert [(r.job_id, r.description_text) for r in feed.job_details(described, wanted).collect()] == [(1, "text")]


def test_csv_read_back(spark, tmp_path):
    cells = [("a, \"b\"", "line\nbreak", "", "5/100", "—", "ünï", "'x'"), ("", "", "", "", "", "", "")]
    frame = spark.createDataFrame(cells, exports.CSV_HEADER)
    exports.write_csv(frame, f"{tmp_path}/csv")
    assert sorted(map(tuple, exports.read_csv(spark, f"{tmp_path}/csv").collect())) == sorted(cells)


def test_a_failed_export_shows_nothing(spark, tmp_path):
    frame = spark.range(100).repartition(4).select(*[F.when(F.col("id") < 99, "x").otherwise(F.raise_error(F.lit("broken"))).alias(n) for n in exports.CSV_HEADER])
    with pytest.raises(Exception, match="broken"):
        exports.write_csv(frame, f"{tmp_path}/csv")
    assert not [f for f in (tmp_path / "csv").glob("part-*")] and not (tmp_path / "csv/_SUCCESS").exists()


def test_sitemap_files_are_split(spark, jobs, tmp_path):
    rows = exports.sitemap(jobs, "https://s.example/", ages.moment("2024-06-01 00:00:00")).coalesce(1)
    exports.write_sitemap(rows, f"{tmp_path}/map", most=50)
    files = sorted((tmp_path / "map").glob("part-*"))
    assert len(files) == -(-rows.count() // 50) and all(f.read_text().count("<url>") <= 50 for f in files)
    assert files[0].read_text().rstrip().endswith("</urlset>")
    key = lambda r: (r.url, r.change_frequency, r.priority, r.last_modified)
    assert sorted(map(key, exports.read_sitemap(spark, f"{tmp_path}/map").collect()), key=repr) == sorted(map(key, rows.collect()), key=repr)


def test_skipped_searches(spark):
    facets = "array<struct<title:string,count:int>>"
    rows = [("small", 2000, []), ("bare", 2500, []), ("none", 2500, None), ("split", 5000, [("a", 2001), ("b", 2000)])]
    totals = spark.createDataFrame(rows, f"company string, total int, facets {facets}")
    found = sorted((r.company, r.facet or "", r.rows) for r in crawl.skipped_searches(totals).collect())
    assert found == [("bare", "", 500), ("none", "", 500), ("split", "a", 2001)]
