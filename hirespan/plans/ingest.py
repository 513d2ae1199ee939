"""Raw postings: listings, boards, crawl plans, stored JSON, exports, uploads.

Payload texts are put together from the supplied tables, in pages of a fixed number of rows,
and then read by the sources.
"""

from pyspark.sql import functions as F

from hirespan.functions import ages
from hirespan.operators import applications as apps
from hirespan.plans.bindings import AS_OF
from hirespan.plans.candidates import LIST_SQL, _listed
from hirespan.plans.registry import query
from hirespan.plans.texts import SPACE
from hirespan.session import shared_folder
from hirespan.sources import boards, columns, crawl, exports, listings, uploads

PER_PAGE = 20
KEY_SHOWN = ["source", "source_job_id", "source_url", "title", "company", "location", "employment_type",
             "description_hash", "status", "posted_at"]


def _pages(rows, key, line, head, tail):
    """One text per ``PER_PAGE`` rows, lines in key order."""
    lines = rows.groupBy(F.floor(F.col(key) / PER_PAGE).alias("page_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line")))).alias("_lines")
    )
    body = F.concat(F.lit(head), F.array_join(F.transform("_lines", lambda item: item["line"]), ""), F.lit(tail))
    return lines.select("page_id", body.alias("body"))


def _text(name):
    return F.col(name).cast("string")


def _markdown(load):
    part = load("part")
    link = F.when(F.col("p_size") % 7 == 0, "apply by mail").otherwise(
        F.concat(F.lit("[Apply](https://jobs.example.com/m/"), _text("p_partkey"), F.lit(") or later"))
    )
    line = F.concat(
        F.lit(" | "), F.when(F.col("p_size") % 10 == 0, " ").otherwise(F.col("p_brand")), F.lit(" |  "),
        F.col("p_name"), F.lit(" | "), F.col("p_type"), F.lit(" | "), link, F.lit(" |\n"),
    )
    return _pages(part, "p_partkey", line, "# Jobs\n| Company | Role | Location | Link |\n| --- | --- | --- | --- |\n", "")


MARKDOWN_SQL = """
  select 'github-simplify' as source, sha256(concat('https://jobs.example.com/m/', p_partkey)) as source_job_id,
    concat('https://jobs.example.com/m/', p_partkey) as source_url, p_name as title, p_brand as company,
    p_type as location, 'INTERNSHIP' as employment_type,
    sha256(concat(p_name, ' at ', p_brand, ' - ', p_type)) as description_hash, 'ACTIVE' as status,
    cast(null as timestamp) as posted_at
  from part where p_size % 7 <> 0 and p_size % 10 <> 0"""


@query("markdown_listing_s1", MARKDOWN_SQL)
def markdown_listing(load):
    return boards.union_postings(listings.parse_listings(_markdown(load))).select(KEY_SHOWN)


def _html(load):
    """Rows of a page share the company above unless they name one; some lack a role or a link."""
    size = F.col("p_size")
    company = (
        F.when(size % 3 == 0, "↳")
        .when(size % 3 == 1, " ")
        .otherwise(F.concat(F.lit('<strong><a href="https://simplify.jobs/c/x">'), "p_brand", F.lit(" &amp; Co</a></strong> 🔥")))
    )
    role = F.when(size % 10 == 0, "").otherwise(F.concat(F.col("p_name"), F.lit(" &eacute;t&#233;")))
    link = F.when(size % 7 == 0, '<a href="/mail">mail</a>').otherwise(
        F.concat(
            F.lit('<div><a href="https://simplify.jobs/p/1">S</a> <a href="https://jobs.example.com/h?a=1&amp;b='),
            _text("p_partkey"), F.lit('">Apply</a></div>'),
        )
    )
    row_open = F.when(size % 11 == 0, '<tr class="x">').otherwise("<tr>")
    line = F.concat(
        row_open, F.lit("\n<td>"), company, F.lit("</td>\n<td>"), role, F.lit('</td>\n<td align="left">'), F.col("p_type"),
        F.lit("<br/>Remote</td>\n<td>"), link, F.lit("</td>\n<td>1d</td></tr>\n"),
    )
    return _pages(load("part"), "p_partkey", line, "<table>\n<tbody>\n", "</tbody></table>")


HTML_SQL = """
  select 'github-simplify' as source, sha256(url) as source_job_id, url as source_url, title, company, location,
    'INTERNSHIP' as employment_type, sha256(concat(title, ' at ', company, ' - ', location)) as description_hash,
    'ACTIVE' as status, cast(null as timestamp) as posted_at
  from (
    select p_partkey, p_size, concat('https://jobs.example.com/h?a=1&b=', p_partkey) as url, concat(p_name, ' été') as title,
      concat(p_type, ', Remote') as location,
      last_value(case when p_size % 3 = 2 then concat(p_brand, ' & Co') end ignore nulls)
        over (partition by p_partkey // 20 order by p_partkey rows between unbounded preceding and current row) as company
    from part where p_size % 11 <> 0)
  where company is not null and p_size % 7 <> 0 and p_size % 10 <> 0"""


@query("html_listing_s2_w3_p16", HTML_SQL)
def html_listing(load):
    return boards.union_postings(listings.parse_listings(_html(load))).select(KEY_SHOWN)


def _landing(documents, body, token="board"):
    """Responses of ten documents each; those starting with a German text are broken off."""
    grouped = documents.groupBy(F.floor(F.col("doc_id") / 10).alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", F.col("lang").alias("l"), body.alias("b")))).alias("_items")
    )
    return grouped.select(
        F.concat(F.lit("Firm "), _text("page")).alias("company"),
        F.concat(F.lit(f"{token}"), _text("page")).alias("token"),
        (F.get("_items", F.lit(0))["l"] == "de").alias("_broken"),
        F.transform("_items", lambda item: item["b"]).alias("_items"),
    )


def _cut(frame, whole):
    return frame.select(
        "company",
        "token",
        F.when(F.col("_broken"), F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("body"),
    )


DOCUMENT_PAGES = """
  good as (select doc_id // 10 as page from documents group by 1 having min_by(lang, doc_id) <> 'de'),
  docs as (select d.*, g.page from documents d join good g on g.page = d.doc_id // 10)"""
STRIPPED = f"trim(regexp_replace(regexp_replace(concat('<p>', text, '</p>'), '<[^>]*>', ' ', 'g'), '{SPACE}', ' ', 'g'))"


def _boards(load):
    title = F.when(F.col("lang") == "en", "Data Co-op").when(F.col("lang") == "fr", "Internal tools").otherwise("Engineer")
    body = F.struct(
        F.col("doc_id").alias("id"),
        title.alias("title"),
        F.struct(F.col("lang").alias("name")).alias("location"),
        F.concat(F.lit("https://boards.example.com/"), _text("doc_id")).alias("absolute_url"),
        F.concat(F.lit("2024-03-"), F.lpad((F.col("n_chars") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00-05:00")).alias("updated_at"),
        F.concat(F.lit("<p class=\"x\">"), "text", F.lit("</p>")).alias("content"),
    )
    frame = _landing(load("documents"), body)
    return _cut(frame, F.to_json(F.struct(F.col("_items").alias("jobs"))))


BOARD_SQL = f"""
  select 'greenhouse' as source, concat('gh-board', page, '-', doc_id) as source_job_id,
    concat('https://boards.example.com/', doc_id) as source_url,
    case lang when 'en' then 'Data Co-op' else 'Internal tools' end as title, concat('Firm ', page) as company,
    lang as location, 'INTERNSHIP' as employment_type,
    sha256({STRIPPED}) as description_hash, 'ACTIVE' as status,
    cast(timestamp '2024-03-01 15:00:00' + to_days(cast(n_chars % 28 as int)) as timestamp) as posted_at
  from docs where lang in ('en', 'fr')"""


@query("board_postings_s4_p15", "with " + DOCUMENT_PAGES + BOARD_SQL)
def board_postings(load):
    read, _ = boards.parse_board(_boards(load))
    return boards.union_postings(read).select(KEY_SHOWN)


@query(
    "fetch_report_a14",
    """select concat('Firm ', page) as company, count(*) as total,
         count(*) filter (first_lang = 'de') as errors, count(*) filter (first_lang = 'de') > 0 as failed
       from (select doc_id // 10 as page, min_by(lang, doc_id) as first_lang from documents group by 1) group by 1""",
)
def fetch_report(load):
    return boards.fetch_report(_boards(load))


def _postings(load):
    english = F.col("lang") == "en"
    body = F.struct(
        F.concat(F.lit("p"), _text("doc_id")).alias("id"),
        F.when(english, "Engineer").otherwise("Intern, data").alias("text"),
        F.col("text").alias("descriptionPlain"),
        F.when(F.col("n_chars") > 2000, "<b>More</b>  to\ncome").alias("additional"),
        F.concat(F.lit("https://postings.example.com/"), _text("doc_id")).alias("hostedUrl"),
        F.struct(F.when(english, "Summer INTERN").otherwise("Full time").alias("commitment"), "source").withField(
            "location", F.col("source")
        ).alias("categories"),
        (F.col("doc_id") * 86_400_000).alias("createdAt"),
        F.when(
            F.col("lang") != "fr",
            F.struct((F.col("n_chars") + 0.5).alias("min"), (F.col("n_chars") * 2.5).alias("max"),
                     F.lit("EUR").alias("currency"), F.lit("per-year").alias("interval")),
        ).alias("salaryRange"),
    )
    frame = _landing(load("documents"), body, "slug")
    return _cut(frame, F.to_json("_items"))


POSTING_SQL = """
  select 'lever' as source, concat('lever-slug', page, '-p', doc_id) as source_job_id,
    concat('https://postings.example.com/', doc_id) as source_url,
    case when lang = 'en' then 'Engineer' else 'Intern, data' end as title, concat('Firm ', page) as company,
    source as location, 'INTERNSHIP' as employment_type,
    sha256(concat(text, case when n_chars > 2000 then concat(chr(10), chr(10), 'More to come') else '' end,
      case when lang <> 'fr' then concat(chr(10), chr(10), 'Salary: EUR ', cast(round_even(n_chars + 0.5e0, 0) as bigint), '-',
        cast(round_even(n_chars * 2.5e0, 0) as bigint), '/per-year') else '' end)) as description_hash, 'ACTIVE' as status,
    make_timestamp(doc_id * 86400000000) as posted_at
  from docs"""


@query("lever_postings_s5", "with " + DOCUMENT_PAGES + POSTING_SQL)
def lever_postings(load):
    read, _ = boards.parse_postings(_postings(load))
    return boards.union_postings(read).select(KEY_SHOWN)


def _lists(load):
    """Search lists of twenty orders; each list is one company's."""
    orders = load("orders")
    status = F.col("o_orderstatus")
    place = F.struct(F.concat(F.lit("City "), _text("o_custkey")).alias("city"), F.lit("Land").alias("country"))
    body = F.struct(
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("https://lists.example.com/"), _text("o_orderkey")).alias("externalUrl"),
        F.when(status == "F", F.array().cast("array<struct<city:string,country:string>>")).otherwise(F.array(place, place)).alias("locations"),
        F.when(status == "P", "Posted Today").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("postedOn"),
    )
    grouped = orders.groupBy(F.floor(F.col("o_orderkey") / PER_PAGE).alias("page")).agg(F.collect_list(body).alias("_items"))
    return grouped.select(
        F.concat(F.lit("List "), _text("page")).alias("company"),
        F.lit("").alias("token"),
        F.to_json(F.struct(F.size("_items").alias("total"), F.col("_items").alias("jobPostings"))).alias("body"),
    )


LIST_POSTING_SQL = """
  select 'workday' as source, cast(null as varchar) as source_job_id, concat('https://lists.example.com/', o_orderkey) as source_url,
    o_orderpriority as title, concat('List ', o_orderkey // 20) as company,
    case when o_orderstatus = 'F' then '' else concat('City ', o_custkey, ', Land') end as location,
    'FULL_TIME' as employment_type, sha256(concat(o_orderpriority, ' at List ', o_orderkey // 20)) as description_hash,
    'ACTIVE' as status, case when o_orderstatus <> 'P' then date_trunc('day', o_orderdate) end as posted_at
  from orders"""


@query("workday_list_s6", LIST_POSTING_SQL)
def workday_list(load):
    read, _ = boards.parse_list(_lists(load))
    return boards.union_postings(read).select(KEY_SHOWN)


@query(
    "workday_detail_s7",
    """select 'workday' as source, case when o_orderstatus = 'P' then null else concat('R', o_orderkey) end as source_job_id,
         concat('https://details.example.com/', o_orderkey) as source_url, o_orderpriority as title,
         concat('Customer ', o_custkey) as company, '' as location, 'FULL_TIME' as employment_type,
         sha256(concat('<p>', o_orderstatus)) as description_hash, 'ACTIVE' as status, date_trunc('day', o_orderdate) as posted_at
       from orders""",
)
def workday_detail(load):
    body = F.struct(
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("R"), _text("o_orderkey"))).alias("jobReqId"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("<p>"), "o_orderstatus").alias("jobDescription"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("postedOn"),
    )
    landing = load("orders").select(
        F.concat(F.lit("Customer "), _text("o_custkey")).alias("company"),
        F.concat(F.lit("https://details.example.com/"), _text("o_orderkey")).alias("url"),
        F.to_json(body).alias("body"),
    )
    read, _ = boards.parse_detail(landing)
    return boards.union_postings(read).select(KEY_SHOWN)


@query(
    "union_sources_u1",
    "with " + DOCUMENT_PAGES + f"""
      select source, count(*) as postings, count(distinct source_url) as urls, count(distinct description_hash) as texts,
        max(posted_at) as newest
      from ({MARKDOWN_SQL} union all {HTML_SQL} union all {BOARD_SQL} union all {POSTING_SQL} union all {LIST_POSTING_SQL})
      group by source""",
)
def union_sources(load):
    everything = boards.union_postings(
        listings.parse_listings(_markdown(load)),
        listings.parse_listings(_html(load)),
        boards.parse_board(_boards(load))[0],
        boards.parse_postings(_postings(load))[0],
        boards.parse_list(_lists(load))[0],
    )
    return everything.groupBy("source").agg(
        F.count(F.lit(1)).alias("postings"),
        F.count_distinct("source_url").alias("urls"),
        F.count_distinct("description_hash").alias("texts"),
        F.max("posted_at").alias("newest"),
    )


CRAWL_TOTALS = """
         select s_name as company, count(*) as total, null as facet, null as facet_count
           from lineitem join supplier on s_suppkey = l_suppkey group by s_name
         union all select concat('status ', l_linestatus), count(*), null, null from lineitem group by l_linestatus
         union all select p_brand, sum(count(*)) over (partition by p_brand), concat('line ', l_linenumber), count(*)
           from lineitem join part on p_partkey = l_partkey group by p_brand, l_linenumber
         union all select concat('flag ', l_returnflag), sum(count(*)) over (partition by l_returnflag), concat('line ', l_linenumber), count(*)
           from lineitem group by l_returnflag, l_linenumber"""


@query(
    "crawl_plan_s8",
    f"""with totals as ({CRAWL_TOTALS}),
       searches as (
         select company, facet, facet_count as n from totals where total > 2000 and facet is not null and facet_count <= 2000
         union all select distinct company, cast(null as varchar), least(total, 2000) from totals
           where total <= 2000 or facet is null)
       select company, facet, cast(unnest(range(0, cast(n as bigint), 20)) as int) as page_offset from searches""",
)
def crawl_plan(load):
    return crawl.crawl_plan(_crawl_totals(load))


@query(
    "crawl_skipped_s8",
    f"""with totals as ({CRAWL_TOTALS})
       select company, facet, cast(facet_count as int) as rows, 'facet is too large' as reason from totals
         where total > 2000 and facet_count > 2000
       union all select company, null, cast(total - 2000 as int), 'too many rows and no facets' from totals
         where total > 2000 and facet is null""",
)
def crawl_skipped(load):
    return crawl.skipped_searches(_crawl_totals(load))


def _crawl_totals(load):
    items = load("lineitem")
    number = F.count(F.lit(1)).cast("int").alias("n")
    plain_sources = [
        items.join(load("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("s_name").alias("company")).agg(number),
        items.groupBy(F.concat(F.lit("status "), "l_linestatus").alias("company")).agg(number),
    ]
    line = F.concat(F.lit("line "), _text("l_linenumber")).alias("title")
    faceted_sources = [
        items.join(load("part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("company"), line).agg(number),
        items.groupBy(F.concat(F.lit("flag "), "l_returnflag").alias("company"), line).agg(number),
    ]
    kind = "array<struct<title:string,count:int>>"
    plain = plain_sources[0].unionByName(plain_sources[1]).select(
        "company", F.col("n").alias("total"), F.array().cast(kind).alias("facets")
    )
    # At most seven line numbers per company.
    faceted = faceted_sources[0].unionByName(faceted_sources[1]).groupBy("company").agg(
        F.sum("n").cast("int").alias("total"), F.collect_list(F.struct("title", F.col("n").alias("count"))).alias("facets")
    )
    return plain.unionByName(faceted)


@query(
    "json_columns_s10",
    """select event_id, case when event_type in ('view', 'error') then 0 else 1 end as entries,
         case when event_type in ('view', 'error') then null else cast(props->>'k' as int) end as k,
         case when event_type in ('view', 'error') then '{}' else concat('{"k":', props->>'k', '}') end as written,
         case event_type when 'view' then 0 else 2 end as words,
         case event_type when 'view' then '[]' else concat('["', event_type, '","', user_id, '"]') end as words_written
       from events""",
)
def json_columns(load):
    kind = F.col("event_type")
    stored_map = F.when(kind == "view", "  ").when(kind != "error", F.col("props"))
    stored_list = F.when(kind != "view", F.to_json(F.array(kind, _text("user_id"))))
    read = load("events").select(
        "event_id", columns.read_map(stored_map, "int").alias("m"), columns.read_list(stored_list).alias("l")
    )
    return read.select(
        "event_id",
        F.size("m").alias("entries"),
        F.try_element_at("m", F.lit("k")).alias("k"),
        columns.write_json(F.col("m"), "map<string,int>").alias("written"),
        F.size("l").alias("words"),
        columns.write_json(F.col("l"), "array<string>").alias("words_written"),
    )


@query(
    "application_export_s12",
    LIST_SQL
    + """select company as "Company", job_title as "Role", case status when 'APPLIED' then 'Applied' when 'SCORED' then 'Applied'
           when 'INTERVIEWING' then 'Interviewing' when 'OFFER' then '🎉 Offer' when 'REJECTED' then 'Rejected'
           when 'WITHDRAWN' then 'Withdrawn' else 'Failed' end as "Status",
         case when match_score > 0 then concat(match_score, '/100') else '—' end as "Match Score",
         strftime(applied_at, '%b %-d, %Y') as "Applied Date", '' as "Deadline", '' as "Notes"
       from listed""",
)
def application_export(load):
    listed = _listed(load)
    folder = shared_folder(load.spark, "export")
    exports.write_csv(exports.application_export(listed), folder)
    return exports.read_csv(load.spark, folder)


@query(
    "sitemap_s15",
    f"""select 'https://site.example.com/' as url, 'hourly' as change_frequency, 1e0 as priority,
          max(coalesce(posted_at, scraped_at)) as last_modified from v_jobs where status = 'ACTIVE'
        union all select 'https://site.example.com/login', 'monthly', 0.5e0, timestamp '{AS_OF}'
        union all select concat('https://site.example.com/jobs/', job_id), 'hourly', 0.8e0, coalesce(posted_at, scraped_at)
          from v_jobs where status = 'ACTIVE'""",
)
def sitemap(load):
    folder = shared_folder(load.spark, "sitemap")
    exports.write_sitemap(exports.sitemap(load("v_jobs"), "https://site.example.com/", ages.moment(AS_OF)), folder)
    return exports.read_sitemap(load.spark, folder)


UPLOAD = """case when lang = 'en' then concat('%PDF-1.7', chr(10), text) when lang = 'fr' then text
  when lang = 'de' then '%PDF' else '' end"""


@query(
    "upload_checks_s17",
    f"""with u as (select doc_id, source, {UPLOAD} as c, case when source like '%1' then 'text/plain'
            when source like '%2' then null else 'application/PDF' end as content_type from documents)
        select doc_id, content_type, octet_length(encode(c)) as file_size_bytes, sha256(c) as checksum_sha256,
          case when c = '' then 'file is empty' when content_type is null or content_type = 'text/plain' then 'type not supported'
            when c not like '%PDF-%' or octet_length(encode(c)) < 5 or substr(c, 1, 4) <> '%PDF' then 'not a pdf' end as reason
        from u""",
)
def upload_checks(load):
    content = F.encode(F.expr(UPLOAD), "utf-8")
    kind = F.when(F.col("source").like("%1"), "text/plain").when(~F.col("source").like("%2"), "application/PDF")
    files = load("documents").select("doc_id", kind.alias("content_type"), content.alias("content"))
    return uploads.check_uploads(files)
