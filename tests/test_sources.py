import csv
import glob
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hirespan.functions import ages
from hirespan.sources import boards, catalogue, columns, crawl, exports, listings, store, uploads


def now():
    return ages.moment("2024-06-01 00:00:00")



def pages(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "page_id int, body string")


def test_html_listing(spark):
    """Inheritance of the company, the employer's own link, cells with markup and entities."""
    page = """<table><tbody>
    <tr><td><b><a href="https://simplify.jobs/c/Acme">Acme &amp; Sons</a></b></td><td>Platform Intern</td><td>Bonn<br/>Remote</td>
      <td><a href="https://acme.example/jobs/1?a=1&amp;b=2"><img></a> <a href="https://simplify.jobs/p/9"><img></a></td><td>0d</td></tr>
    <tr><td>↳</td><td>Research 🎓</td><td>Köln</td><td><a href="https://acme.example/jobs/2"></a></td><td>1d</td></tr>
    <tr><td>Dropped</td><td> </td><td>Ulm</td><td><a href="https://dropped.example/3"></a></td></tr>
    <tr><td></td><td>Tester 🔥</td><td>Ulm</td><td><a href="https://dropped.example/4"></a></td></tr>
    <tr><td>No link</td><td>Tester</td><td>Ulm</td><td><a href="https://simplify.jobs/p/5"></a></td></tr>
    <tr class="x"><td>Marked</td><td>Tester</td><td>Ulm</td><td><a href="https://marked.example/6"></a></td></tr>
    <tr><td>Short</td><td>Tester</td><td>Ulm</td></tr></tbody></table>"""
    rows = listings.parse_listings(pages(spark, page)).orderBy("position").collect()
    assert [(r.company, r.title, r.location, r.source_url) for r in rows] == [
        ("Acme & Sons", "Platform Intern", "Bonn, Remote", "https://acme.example/jobs/1?a=1&b=2"),
        ("Acme & Sons", "Research 🎓", "Köln", "https://acme.example/jobs/2"),
        ("Dropped", "Tester", "Ulm", "https://dropped.example/4"),
    ]
    assert rows[0].source_job_id == hashlib.sha256(rows[0].source_url.encode()).hexdigest()
    assert rows[1].description_text == "Research 🎓 at Acme & Sons - Köln"
    assert len({r.source_job_id for r in rows}) == 3


def test_html_company_does_not_cross_pages(spark):
    row = '<table><tr><td>{}</td><td>Role</td><td>X</td><td><a href="https://e.example/{}"></a></td></tr></table>'
    found = listings.parse_listings(pages(spark, row.format("First", 1), row.format("↳", 2))).collect()
    assert [r.company for r in found] == ["First"]


def test_markdown_listing(spark):
    page = """| Company | Role | Location | Link |
|---|---|---|---|
  | Acme | Intern | Bonn | [Apply](https://acme.example/1) |
| Good Company | Intern | Bonn | [Apply](https://good.example/2) |
| Acme | Intern | [Apply](https://acme.example/3)
| Acme | Intern | Bonn | apply by mail |
|  | Intern | Bonn | [Apply](https://acme.example/4) |
| ↳ | Second |  | **[Apply](http://acme.example/5)** or |
not a row | a | b | [Apply](https://acme.example/6) |"""
    rows = listings.parse_listings(pages(spark, page)).orderBy("position").collect()
    assert [(r.company, r.title, r.location, r.source_url) for r in rows] == [
        ("Acme", "Intern", "Bonn", "https://acme.example/1"),
        ("↳", "Second", "", "http://acme.example/5"),
    ]


def test_read_pages(spark, tmp_path):
    (tmp_path / "a.md").write_text("| Acme | Intern | Bonn | [x](https://a.example/1) |\nend")
    assert listings.parse_listings(listings.read_pages(spark, str(tmp_path))).count() == 1


def landing(spark, *bodies):
    rows = [("Acme", "acme", b if isinstance(b, str) or b is None else json.dumps(b)) for b in bodies]
    return spark.createDataFrame(rows, "company string, token string, body string")


def test_board(spark):
    good = {"jobs": [
        {"id": 7, "title": "Data Intern", "location": {"name": "Bonn"}, "absolute_url": "https://b.example/7",
         "updated_at": "2024-03-01T10:00:00-05:00", "content": "<p>Go&nbsp;on</p>\n<b>now</b>"},
        {"id": 8, "title": "Engineer", "absolute_url": "https://b.example/8"},
        {"id": 9, "title": "COOP student", "absolute_url": "https://b.example/9"},
    ]}
    read, bad = boards.parse_board(landing(spark, good, json.dumps(good)[:-1], None, {"jobs": []}))
    rows = sorted(read.collect(), key=lambda r: r.source_job_id)
    assert [(r.source_job_id, r.location, r.description_text) for r in rows] == [("gh-acme-7", "Bonn", "Go&nbsp;on now"), ("gh-acme-9", "", "")]
    assert rows[0].posted_at.isoformat() == "2024-03-01T15:00:00" and rows[1].posted_at is None
    assert [r.reason for r in bad.collect()] == ["unreadable response"] * 2
    report = boards.fetch_report(landing(spark, good, "{")).first()
    assert (report.total, report.errors, report.failed) == (2, 1, True)


def test_postings(spark):
    body = [
        {"id": "a", "text": "Engineer", "categories": {"commitment": "Internship", "location": "Bonn"}, "descriptionPlain": "Plain",
         "additional": "<i>More</i>", "hostedUrl": "https://p.example/a", "createdAt": 1700000000000,
         "salaryRange": {"min": 10.5, "max": 11.5, "currency": "EUR", "interval": "hour"}},
        {"id": "b", "text": "Intern", "hostedUrl": "https://p.example/b"},
        {"id": "c", "text": "Engineer", "hostedUrl": "https://p.example/c"},
    ]
    read, _ = boards.parse_postings(landing(spark, body))
    rows = {r.source_job_id: r for r in read.collect()}
    assert set(rows) == {"lever-acme-a", "lever-acme-b"}
    assert rows["lever-acme-a"].description_text == "Plain\n\nMore\n\nSalary: EUR 10-12/hour"
    assert rows["lever-acme-a"].posted_at.isoformat() == "2023-11-14T22:13:20"
    assert rows["lever-acme-b"].description_text == ""


def test_list_and_detail(spark):
    body = {"total": 2, "jobPostings": [
        {"title": "A", "externalUrl": "https://w.example/a", "locations": [{"city": "Bonn", "country": "DE"}, {"city": "x"}], "postedOn": "2024-02-03"},
        {"title": "B", "externalUrl": "https://w.example/b", "locations": [], "postedOn": "Posted today"},
    ]}
    rows = sorted(boards.parse_list(landing(spark, body))[0].collect(), key=lambda r: r.title)
    assert [(r.location, r.description_text, r.source_job_id) for r in rows] == [("Bonn, DE", "A at Acme", None), ("", "B at Acme", None)]
    assert rows[0].posted_at.isoformat() == "2024-02-03T00:00:00" and rows[1].posted_at is None
    detail = {"jobReqId": "R1", "title": "T", "jobDescription": "D", "postedOn": "2024-02-03", "location": "L"}
    row = boards.parse_detail(landing(spark, detail).withColumn("url", F.lit("https://w.example/r1")))[0].first()
    assert (row.source_job_id, row.title, row.location, row.description_text) == ("R1", "T", "L", "D")


@pytest.mark.parametrize(
    "total, facets, offsets",
    [
        (0, [], []), (1, [], [0]), (20, [], [0]), (21, [], [0, 20]), (2000, [("x", 5)], list(range(0, 2000, 20))),
        (2001, [], list(range(0, 2000, 20))), (2001, [("x", 21), ("big", 2001), ("none", 0)], [0, 20]), (2001, [("big", 2001)], []),
    ],
)
def test_crawl_plan(spark, total, facets, offsets):
    frame = spark.createDataFrame([("Acme", total, facets)], "company string, total int, facets array<struct<title:string,count:int>>")
    rows = crawl.crawl_plan(frame).collect()
    assert sorted(r.page_offset for r in rows) == offsets
    assert {r.facet for r in rows} <= ({"x"} if total > 2000 and facets else {None})


def test_json_columns(spark):
    frame = spark.createDataFrame([(' ["a"]', '{"k":1}'), (None, " "), ("\t", None)], "l string, m string")
    read = frame.select(columns.read_list(F.col("l")).alias("l"), columns.read_map(F.col("m"), "int").alias("m"))
    assert [tuple(r) for r in read.collect()] == [(["a"], {"k": 1}), ([], {}), ([], {})]
    written = read.select(columns.write_json(F.col("l"), "array<string>"), columns.write_json(F.lit(None), "map<string,int>")).first()
    assert tuple(written) == ('["a"]', "{}")


def test_seed_only_if_empty(spark, tmp_path):
    path = str(tmp_path / "benchmarks")
    rows = spark.createDataFrame(
        [("Ours", "B", 3), ("Ours", "A", 3), ("Theirs", "C", 9)], "company string, title string, difficulty_level int"
    )
    assert catalogue.load_if_empty(rows, path) and not catalogue.load_if_empty(rows, path)
    ordered = [(r.difficulty_level, r.title) for r in catalogue.hardest_first(spark.read.parquet(path)).collect()]
    assert ordered == [(9, "C"), (3, "A"), (3, "B")]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.read_version(spark, path) is None
    for number in (0, 1, 1):
        store.write_version(spark.range(number + 1), path, number)
    assert store.versions(spark, path) == [0, 1]
    assert store.read_version(spark, path).count() == 2 and store.read_version(spark, path, before=1).count() == 1


def test_schema_check(spark, tmp_path):
    store.write_table(spark.range(3), str(tmp_path / "t"))
    good = StructType([StructField("id", LongType())])
    assert store.read_table(spark, str(tmp_path / "t"), good).count() == 3
    with pytest.raises(ValueError, match="id"):
        store.read_table(spark, str(tmp_path / "t"), StructType([StructField("id", StringType())]))


def test_csv_export(spark, tmp_path):
    frame = spark.createDataFrame(
        [('Say "hi", Ltd', "Role", "OFFER", 0, "2024-01-05 00:00:00", None), ("B", "R", "KILLED", 7, None, "2024-02-01")],
        "company string, job_title string, status string, match_score int, at string, deadline string",
    ).withColumn("applied_at", F.col("at").cast("timestamp"))
    exports.write_csv(exports.application_export(frame).coalesce(1), str(tmp_path / "out"))
    with open(glob.glob(str(tmp_path / "out" / "*.csv"))[0], encoding="utf-8") as file:
        raw = file.read()
    rows = list(csv.reader(raw.splitlines()))
    assert rows == [
        ["Company", "Role", "Status", "Match Score", "Applied Date", "Deadline", "Notes"],
        ['Say "hi", Ltd', "Role", "🎉 Offer", "—", "Jan 5, 2024", "", ""],
        ["B", "R", "KILLED", "7/100", "—", "2024-02-01", ""],
    ]
    assert raw.count('"') == 2 * 21 + 4


def test_sitemap(spark):
    jobs = spark.createDataFrame([(1, "ACTIVE", None, "2024-01-02"), (2, "CLOSED", "2024-01-03", "2024-01-04")], "job_id int, status string, p string, s string")
    jobs = jobs.select("job_id", "status", F.col("p").cast("timestamp").alias("posted_at"), F.col("s").cast("timestamp").alias("scraped_at"))
    rows = exports.sitemap(jobs, "https://x.example/", now()).orderBy("url").collect()
    assert [(r.url, r.priority) for r in rows] == [("https://x.example/", 1.0), ("https://x.example/jobs/1", 0.8), ("https://x.example/login", 0.5)]
    assert rows[0].last_modified.isoformat() == "2024-01-02T00:00:00"


def test_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    assert uploads.read_uploads(spark, str(tmp_path)).first().content == b"%PDF-1.4 x"
    rows = [
        (1, "application/PDF", b"%PDF-1.4"), (2, "application/octet-stream", b"%PDF1"), (3, "text/plain", b"%PDF-1"), (4, None, b"%PDF-1"),
        (5, "application/pdf", b"%PDF"), (6, "application/pdf", b"PK\x03\x04xx"), (7, "application/pdf", b""), (8, "application/pdf", None),
    ]
    frame = spark.createDataFrame(rows, "i int, content_type string, content binary")
    found = {r.i: r for r in uploads.check_uploads(frame).collect()}
    assert [found[i].reason for i in range(1, 9)] == [
        None, None, "type not supported", "type not supported", "not a pdf", "not a pdf", "file is empty", "file is empty",
    ]
    assert found[1].checksum_sha256 == hashlib.sha256(b"%PDF-1.4").hexdigest() and found[1].file_size_bytes == 8
