"""Feed filters, pages, tabs, marks, ages."""

from pyspark.sql import functions as F

from hirespan.functions import ages
from hirespan.functions.text import is_internship, is_internship_posting
from hirespan.operators import feed
from hirespan.plans.bindings import AS_OF, EVENTS_AS_OF
from hirespan.plans.registry import query
from hirespan.schemas import violations
from hirespan.sources import catalogue

SUMMARY = "job_id, title, company, location, employment_type, posted_at, scraped_at, status, source_url"
NOW = f"timestamp '{AS_OF}'"


@query(
    "feed_page_o1_o2",
    f"""select {SUMMARY} from v_jobs where status = 'ACTIVE'
        order by coalesce(posted_at, scraped_at) desc, job_id limit 50 offset 100""",
)
def feed_page(load):
    return feed.feed_page(load("v_jobs").select(feed.SUMMARY_COLUMNS), page=2, size=50)


@query(
    "feed_filters_f3_f7",
    f"""select {SUMMARY} from v_jobs where status = 'ACTIVE' and lower(location) like '%nation_1%'
          and lower(location) like '%remote%' and lower(company) like '%brand#1%'
          and (lower(title) like '%r%g%' or lower(company) like '%r%g%')""",
)
def feed_filters(load):
    jobs = load("v_jobs").select(feed.SUMMARY_COLUMNS)
    return feed.filter_feed(jobs, location="NATION_1", remote=True, company="Brand#1", search="r%G")


@query(
    "feed_filters_off_f7",
    f"select {SUMMARY} from v_jobs where status = 'ACTIVE' and (lower(title) like '%bolt%' or lower(company) like '%bolt%')",
)
def feed_filters_off(load):
    return feed.filter_feed(load("v_jobs").select(feed.SUMMARY_COLUMNS), remote=False, search="Bolt")


@query(
    "feed_summary_a3_a4",
    """select count(*) filter (lower(location) like '%remote%' and lower(company) like '%brand#2%') as total,
         max(coalesce(posted_at, scraped_at)) as last_sync from v_jobs where status = 'ACTIVE'""",
)
def feed_summary(load):
    return feed.feed_summary(load("v_jobs"), remote=True, company="brand#2")


@query("last_sync_a3", "select max(coalesce(posted_at, scraped_at)) as last_sync from v_jobs where status = 'ACTIVE'")
def last_sync(load):
    return feed.last_sync(load("v_jobs"))


@query("active_count_a12", "select count(*) as total_jobs from v_jobs where status = 'ACTIVE'")
def active_count(load):
    return feed.active_count(load("v_jobs"))


@query(
    "newest_active_o6",
    """select title, company, location, posted_at from v_jobs where status = 'ACTIVE'
       order by posted_at desc nulls last, job_id limit 5""",
)
def newest_active(load):
    return feed.newest(load("v_jobs")).select("title", "company", "location", "posted_at")


@query(
    "active_job_lookup_f9",
    f"""select {SUMMARY} from v_jobs where status = 'ACTIVE'
          and job_id in (select event_id % (select count(*) from part) from events where event_type = 'purchase')""",
)
def active_job(load):
    total = load("part").agg(F.count(F.lit(1))).scalar()
    wanted = load("events").where("event_type = 'purchase'").select((F.col("event_id") % total).alias("job_id"))
    return feed.active_job(load("v_jobs").select(feed.SUMMARY_COLUMNS), wanted)


@query(
    "feed_tabs_f10",
    """select job_id,
         (employment_type = 'INTERNSHIP' or lower(title) like '%intern%') as in_intern_tab,
         not (employment_type = 'INTERNSHIP' and lower(title) not like '%new grad%') as in_new_grad_tab from v_jobs""",
)
def feed_tabs(load):
    return load("v_jobs").select(
        "job_id", feed.in_tab("intern").alias("in_intern_tab"), feed.in_tab("new-grad").alias("in_new_grad_tab")
    )


@query(
    "hide_applied_f11",
    """select e.event_id, e.user_id, e.event_id % (select count(*) from part) as job_id from events e
       where not exists (select 1 from v_applications a
         where a.user_id = e.user_id and a.job_id = e.event_id % (select count(*) from part))""",
)
def hide_applied(load):
    return feed.hide_applied(_impressions(load), load("v_applications"), ["user_id", "job_id"])


def _impressions(load):
    total = load("part").agg(F.count(F.lit(1))).scalar()
    return load("events").select("event_id", "user_id", (F.col("event_id") % total).alias("job_id"))


@query(
    "mark_feed_j11",
    """select e.event_id, e.user_id, e.event_id % (select count(*) from part) as job_id,
         s.user_id is not null as is_saved, a.user_id is not null as already_applied
       from events e
       left join v_saved s on s.user_id = e.user_id and s.job_id = e.event_id % (select count(*) from part)
       left join v_applications a on a.user_id = e.user_id and a.job_id = e.event_id % (select count(*) from part)""",
)
def mark_feed(load):
    return feed.mark_feed(_impressions(load), load("v_saved"), load("v_applications"), ["user_id", "job_id"])


@query(
    "haystack_search_f12",
    f"""select {SUMMARY} from v_jobs
        where lower(concat_ws(' ', title, company, location)) like '%ring brand#1%'""",
)
def haystack(load):
    return load("v_jobs").select(feed.SUMMARY_COLUMNS).where(feed.haystack_contains(" Ring Brand#1 "))


@query(
    "internship_titles_f1_f2",
    """select doc_id, lower(text) like '%intern%' or lower(text) like '%co-op%' or lower(text) like '%coop%' as by_title,
         lower(text) like '%intern%' or lower(text) like '%co-op%' or lower(text) like '%coop%'
           or lower(source) like '%intern%' as by_commitment
       from documents""",
)
def internship_titles(load):
    text, source = F.col("text"), F.col("source")
    return load("documents").select(
        "doc_id", is_internship(text).alias("by_title"), is_internship_posting(text, source).alias("by_commitment")
    )


@query(
    "job_summaries_f19",
    f"select {SUMMARY} from v_jobs",
)
def job_summaries(load):
    return load("v_jobs").select(feed.SUMMARY_COLUMNS)


@query(
    "feed_deep_page_o2",
    f"""select {SUMMARY} from v_jobs where status = 'ACTIVE'
        order by coalesce(posted_at, scraped_at) desc, job_id limit 50 offset 1500""",
)
def feed_deep_page(load):
    return feed.deep_page(load("v_jobs").where(feed.is_active()).select(feed.SUMMARY_COLUMNS), page=30, size=50)


SERVED = f"""
  with page as (select {SUMMARY}, row_number() over (order by coalesce(posted_at, scraped_at) desc, job_id) - 1 as position from v_jobs
      where status = 'ACTIVE' and lower(location) like '%remote%'),
    about as (select count(*) filter (lower(location) like '%remote%') as total,
        max(coalesce(posted_at, scraped_at)) as last_sync from v_jobs where status = 'ACTIVE')
  select {SUMMARY}, position - 25 as position, total, last_sync from page, about where position >= 25 and position < 50"""


@query("feed_served_f19_o1", SERVED)
def feed_served(load):
    return feed.served_page(load("v_jobs").select(feed.SUMMARY_COLUMNS), page=1, size=25, remote=True)


@query(
    "job_details_f19",
    """with d as (select doc_id as job_id, text as description_text, source, lang,
           case when doc_id % 3 = 0 then 'CLOSED' else 'ACTIVE' end as status from documents)
       select job_id, concat('Role ', lang) as title, source as company, lang as location, 'INTERNSHIP' as employment_type,
         cast(null as timestamp) as posted_at, timestamp '2001-01-01 00:00:00' as scraped_at, status,
         concat('https://jobs.example.com/', job_id) as source_url, description_text
       from d where status = 'ACTIVE' and job_id in (select event_id from events where event_type = 'view')""",
)
def job_details(load):
    jobs = load("documents").select(
        F.col("doc_id").alias("job_id"), F.concat(F.lit("Role "), "lang").alias("title"), F.col("source").alias("company"),
        F.col("lang").alias("location"), F.lit("INTERNSHIP").alias("employment_type"), F.lit(None).cast("timestamp").alias("posted_at"),
        F.lit("2001-01-01 00:00:00").cast("timestamp").alias("scraped_at"),
        F.when(F.col("doc_id") % 3 == 0, "CLOSED").otherwise("ACTIVE").alias("status"),
        F.concat(F.lit("https://jobs.example.com/"), F.col("doc_id").cast("string")).alias("source_url"), F.col("text").alias("description_text"),
    )
    wanted = load("events").where("event_type = 'view'").select(F.col("event_id").alias("job_id"))
    return feed.job_details(jobs, wanted)


AGE = "(epoch_ms({now}) - epoch_ms({when}))"
LABEL = """case when {when} is null or {age} < 0 or {age} > 31536000000 then ''
  when {age} // 3600000 < 1 then 'just now' when {age} // 3600000 < 24 then concat({age} // 3600000, 'h ago')
  when {age} // 86400000 < 7 then concat({age} // 86400000, 'd ago')
  when {age} // 86400000 < 30 then concat({age} // 86400000 // 7, 'w ago')
  else concat({age} // 86400000 // 30, 'mo ago') end"""


def _label(when: str, now: str) -> str:
    return LABEL.format(when=when, age=AGE.format(when=when, now=now))


@query(
    "age_buckets_p11",
    f"select age, count(*) as jobs from (select {_label('scraped_at', NOW)} as age from v_jobs) group by age",
)
def age_buckets(load):
    label = ages.age_label(F.col("scraped_at"), ages.moment(AS_OF)).alias("age")
    return load("v_jobs").groupBy(label).agg(F.count(F.lit(1)).alias("jobs"))


EVENT_AGE = AGE.format(when="ts", now=f"timestamp '{EVENTS_AS_OF}'")


@query(
    "sync_age_p11",
    f"""select event_id, case when {EVENT_AGE} < 60000 then 'just now'
          when {EVENT_AGE} < 3600000 then concat({EVENT_AGE} // 60000, 'm ago')
          when {EVENT_AGE} < 86400000 then concat({EVENT_AGE} // 3600000, 'h ago')
          else concat({EVENT_AGE} // 86400000, 'd ago') end as age from events""",
)
def sync_age(load):
    return load("events").select("event_id", ages.sync_label(F.col("ts"), ages.moment(EVENTS_AS_OF)).alias("age"))


@query(
    "posting_age_p12",
    f"""select job_id, coalesce(nullif({_label('posted_at', NOW)}, ''), '~' || {_label('scraped_at', NOW)}) as age,
          {AGE.format(when='coalesce(posted_at, scraped_at)', now=NOW)} < 86400000 as is_new from v_jobs""",
)
def posting_age(load):
    posted, scraped, now = F.col("posted_at"), F.col("scraped_at"), ages.moment(AS_OF)
    return load("v_jobs").select(
        "job_id", ages.posting_age(posted, scraped, now).alias("age"), ages.is_new(posted, scraped, now).alias("is_new")
    )


@query(
    "deadline_flags_p13",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
         l_shipdate > timestamp '1998-07-01' and l_shipdate < timestamp '1998-07-08' as is_urgent,
         l_shipdate < timestamp '1998-07-01' as is_past
       from lineitem""",
)
def deadline_flags(load):
    now, due = ages.moment("1998-07-01 00:00:00"), F.col("l_shipdate")
    return load("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        ages.deadline_urgent(due, now).alias("is_urgent"), ages.deadline_past(due, now).alias("is_past"),
    )


@query(
    "hardest_first_o4",
    "select p_name as title, p_brand as company, p_size as difficulty_level from part",
)
def hardest_first(load):
    named = load("part").select(
        F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_size").alias("difficulty_level")
    )
    return catalogue.hardest_first(named)


@query(
    "table_rules_f15",
    """select user_id, email, concat_ws(',', case when length(display_name) > 120 then 'display_name is too long' end,
         case when visibility not in ('PRIVATE', 'PUBLIC') then 'profile_visibility is not allowed' end) as reasons
       from (select c_custkey as user_id, concat('user', c_custkey) as email,
           case when c_acctbal < 0 then repeat(c_name, 7) else c_name end as display_name, c_mktsegment as visibility from customer)
       where length(display_name) > 120 or visibility not in ('PRIVATE', 'PUBLIC')""",
)
def table_rules(load):
    """No market segment is an allowed visibility, and the long names break a second rule."""
    users = load("customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("email"),
        F.when(F.col("c_acctbal") < 0, F.repeat("c_name", F.lit(7))).otherwise(F.col("c_name")).alias("display_name"),
        F.col("c_mktsegment").alias("profile_visibility"),
    )
    return violations(users, "users").select("user_id", "email", F.concat_ws(",", "reasons").alias("reasons"))
