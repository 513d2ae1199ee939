"""Table upkeep: upserts, closings, deletes, status logs, new users."""

from pyspark.sql import functions as F

from hirespan.functions import ages
from hirespan.operators import lifecycle, tables
from hirespan.plans.bindings import AS_OF
from hirespan.plans.registry import query

NOW = f"timestamp '{AS_OF}'"
URL = "concat('https://jobs.example.com/', cast({k} as varchar(20)))"

# Postings seen per line item: the same part is seen many times, under clashing source keys.
# Equal arrivals are equal rows.
SEEN_ITEMS = f"""
  select concat_ws('-', cast(l_orderkey as varchar(20)), cast(l_linenumber as varchar(20)), cast(l_suppkey as varchar(20)),
      cast(cast(l_quantity as bigint) as varchar(20)), cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20)),
      cast(cast(round(l_discount * 100) as bigint) as varchar(20)), l_returnflag, l_linestatus) as arrival,
    {URL.format(k='l_partkey * 2')} as source_url, case when l_suppkey % 2 = 0 then 'greenhouse' else 'lever' end as source,
    case when l_quantity < 5 then '' else concat('k', cast(l_partkey % 500 as varchar(20)), l_returnflag) end as source_job_id,
    concat('Role ', l_returnflag) as title, concat('Firm ', l_linestatus) as company, l_returnflag as location,
    'INTERNSHIP' as employment_type, concat('Text ', cast(l_quantity as varchar(20))) as description_text,
    cast(l_linenumber as int) as minimum_years_experience, cast(null as varchar(20)) as education_level,
    case when l_discount > 0.02 then l_shipdate end as posted_at, l_shipdate as scraped_at
  from {{lineitem}}"""
SEEN_ORDERS = f"""
  select o_orderkey as arrival, {URL.format(k='o_orderkey % 5000 * 3')} as source_url, 'greenhouse' as source,
    concat('k', cast(o_orderkey % 4000 as varchar(20))) as source_job_id,
    concat('Role ', o_orderstatus) as title, concat('Firm ', o_orderpriority) as company, o_orderstatus as location,
    'INTERNSHIP' as employment_type, concat('Text ', cast(o_orderkey as varchar(20))) as description_text,
    cast(o_orderkey % 7 as int) as minimum_years_experience, cast(null as varchar(20)) as education_level,
    case when o_orderstatus <> 'F' then o_orderdate end as posted_at, o_orderdate as scraped_at
  from {{orders}}"""
# The table before: all parts. Half of what is seen is under URLs that it does not have.
PRESENT = f"""
  select concat('j', cast(p_partkey as varchar(20))) as job_id, 'greenhouse' as source,
    concat('k', cast(p_partkey % 500 as varchar(20)), substr(p_type, 1, 1)) as source_job_id,
    {URL.format(k='p_partkey')} as source_url, p_name as title, p_brand as company, p_type as location,
    'FULL_TIME' as employment_type, p_name as description_text, p_name as description_hash,
    case when p_size % 2 = 0 then 'CLOSED' else 'ACTIVE' end as status, p_size as minimum_years_experience,
    cast('PHD' as varchar(20)) as education_level, case when p_size % 3 = 0 then timestamp '1990-01-01 00:00:00' end as posted_at,
    timestamp '1990-01-02 00:00:00' as scraped_at, timestamp '1990-01-03 00:00:00' as created_at,
    timestamp '1990-01-04 00:00:00' as updated_at
  from {{part}}"""


def _upsert_sql(seen: str, result: str) -> str:
    names = {"part": "part", "orders": "orders", "lineitem": "lineitem"}
    return f"""
      with seen as ({seen.format(**names)}), present as ({PRESENT.format(**names)}),
      folded as (
        select source_url, min_by(source, (scraped_at, arrival)) as source,
          nullif(min_by(source_job_id, (scraped_at, arrival)), '') as source_job_id,
          min_by(minimum_years_experience, (scraped_at, arrival)) as years, max_by(title, (scraped_at, arrival)) as title,
          max_by(company, (scraped_at, arrival)) as company, max_by(location, (scraped_at, arrival)) as location,
          max_by(description_text, (scraped_at, arrival)) as description_text,
          min_by(posted_at, (scraped_at, arrival)) filter (posted_at is not null) as posted_at,
          max(scraped_at) as scraped_at, min((scraped_at, arrival)) as first_seen
        from seen group by source_url),
      fresh as (select * from folded where source_url not in (select source_url from present) and source_job_id is not null),
      ranked as (select *, row_number() over (partition by source, source_job_id order by first_seen, source_url) as n from fresh),
      clash as (select source_url, source, source_job_id from ranked
        where n > 1 or (source, source_job_id) in (select (source, source_job_id) from present)),
      ok as (select * from folded where source_url not in (select source_url from clash))
      {result}"""


REJECTS = "select source_url, source, source_job_id, 'source key belongs to another url' as reason from clash"
MERGED = f"""
  select coalesce(p.job_id, sha256(o.source_url)) as job_id, coalesce(p.source, o.source) as source,
    case when p.source_url is not null then p.source_job_id else o.source_job_id end as source_job_id,
    coalesce(p.source_url, o.source_url) as source_url,
    coalesce(o.title, p.title) as title, coalesce(o.company, p.company) as company, coalesce(o.location, p.location) as location,
    case when o.source_url is not null then 'INTERNSHIP' else p.employment_type end as employment_type,
    coalesce(o.description_text, p.description_text) as description_text,
    case when o.source_url is not null then sha256(o.description_text) else p.description_hash end as description_hash,
    case when o.source_url is not null then 'ACTIVE' else p.status end as status,
    coalesce(p.minimum_years_experience, o.years) as minimum_years_experience, p.education_level as education_level,
    coalesce(p.posted_at, o.posted_at) as posted_at, coalesce(o.scraped_at, p.scraped_at) as scraped_at,
    coalesce(p.created_at, {NOW}) as created_at, case when o.source_url is not null then {NOW} else p.updated_at end as updated_at
  from present p full join ok o on o.source_url = p.source_url"""


def _times(frame, *names):
    return frame.withColumns({name: F.col(name).cast("timestamp") for name in names})


def _upsert(load, seen: str):
    part = load("part")
    target = part.sparkSession.sql(PRESENT, part=part)
    source = "lineitem" if "{lineitem}" in seen else "orders"
    batch = part.sparkSession.sql(seen, **{source: load(source)})
    return tables.upsert_jobs(
        _times(target, "posted_at", "scraped_at", "created_at", "updated_at"),
        _times(batch, "posted_at", "scraped_at"),
        ages.moment(AS_OF),
    )


@query("job_upsert_u5_w6", _upsert_sql(SEEN_ITEMS, MERGED))
def job_upsert(load):
    return _upsert(load, SEEN_ITEMS)[0]


@query("job_upsert_rejects_u5", _upsert_sql(SEEN_ITEMS, REJECTS))
def job_upsert_rejects(load):
    return _upsert(load, SEEN_ITEMS)[1]


@query("job_upsert_by_orders_u5_w6", _upsert_sql(SEEN_ORDERS, MERGED))
def job_upsert_by_orders(load):
    return _upsert(load, SEEN_ORDERS)[0]


@query(
    "requirement_upsert_u6_u7",
    """with t as (select job_id, required_text, preferred_text from v_requirements),
       b as (select doc_id * 2 as job_id, max_by(lang, doc_id) as required_text, max_by(source, doc_id) as preferred_text
         from documents group by doc_id * 2)
       select coalesce(b.job_id, t.job_id) as job_id, case when b.job_id is null then t.required_text else b.required_text end as required_text,
         case when b.job_id is null then t.preferred_text else b.preferred_text end as preferred_text
       from t full join b on b.job_id = t.job_id""",
)
def requirement_upsert(load):
    batch = load("documents").select(
        (F.col("doc_id") * 2).alias("job_id"), F.col("lang").alias("required_text"),
        F.col("source").alias("preferred_text"), "doc_id",
    )
    return tables.upsert_latest(load("v_requirements"), batch, ["job_id"], ["doc_id"])


@query(
    "profile_upsert_u7",
    """with t as (select resume_id, years_experience, education_level from v_profiles),
       b as (select user_id as resume_id, cast(max_by(event_id, (ts, event_id)) % 40 as int) as years_experience,
           max_by(event_type, (ts, event_id)) as education_level from events group by user_id)
       select coalesce(b.resume_id, t.resume_id) as resume_id,
         case when b.resume_id is null then t.years_experience else b.years_experience end as years_experience,
         case when b.resume_id is null then t.education_level else b.education_level end as education_level
       from t full join b on b.resume_id = t.resume_id""",
)
def profile_upsert(load):
    target = load("v_profiles").select("resume_id", "years_experience", "education_level")
    batch = load("events").select(
        F.col("user_id").alias("resume_id"), (F.col("event_id") % 40).cast("int").alias("years_experience"),
        F.col("event_type").alias("education_level"), "ts", "event_id",
    )
    return tables.upsert_latest(target, batch, ["resume_id"], ["ts", "event_id"])


@query(
    "close_stale_u8",
    f"""select job_id, scraped_at, case when status = 'ACTIVE' and scraped_at < {NOW} - interval 150 day then 'CLOSED' else status end as status
        from v_jobs""",
)
def close_stale(load):
    jobs = load("v_jobs").select("job_id", "scraped_at", "status")
    return tables.close_stale(jobs, ages.moment(AS_OF), days=150)


PROBES = """
  select event_id as probe_id, event_id % (select count(*) from part) as job_id,
    case event_type when 'view' then 200 when 'click' then 404 when 'purchase' then 410 when 'signup' then 500 end as status_code,
    case when event_type = 'error' then 'timed out' end as error, ts as checked_at from events"""
LAST_PROBE = f"""
  probes as ({PROBES}),
  last as (select job_id, status_code, error from (
    select *, row_number() over (partition by job_id order by checked_at desc, probe_id desc) as n from probes) where n = 1)"""


def _probes(load):
    spark = load("events").sparkSession
    text = PROBES.replace("from part", "from {part}").replace("from events", "from {events}")
    return spark.sql(text, events=load("events"), part=load("part"))


@query(
    "close_dead_u9",
    "with " + LAST_PROBE + """ select j.job_id, j.source_url, case when l.error is null and l.status_code in (404, 410) and j.status = 'ACTIVE'
        then 'CLOSED' else j.status end as status from v_jobs j left join last l using (job_id)""",
)
def close_dead(load):
    return tables.close_dead(load("v_jobs").select("job_id", "source_url", "status"), _probes(load)).select(
        "job_id", "source_url", "status"
    )


@query(
    "probe_counters_a13",
    "with " + LAST_PROBE + """ select count(*) as total, count(*) filter (l.error is null and l.status_code in (404, 410)) as pruned,
        count(*) filter (l.error is not null) as errors from v_jobs j left join last l using (job_id) where j.status = 'ACTIVE'""",
)
def probe_counters(load):
    return tables.probe_counters(load("v_jobs"), _probes(load))


@query(
    "delete_saved_u10",
    """select saved_id, user_id, job_id, saved_at from v_saved s
       where not exists (select 1 from v_applications a where a.user_id = s.user_id and a.job_id = s.job_id)""",
)
def delete_saved(load):
    return tables.delete_rows(load("v_saved"), load("v_applications"), ["user_id", "job_id"])


@query(
    "latest_status_u11",
    """select user_id, max_by(event_type, (ts, event_id)) as status, max(ts) as changed_at from events group by user_id""",
)
def latest_status(load):
    log = load("events").select("user_id", F.col("event_type").alias("status"), "ts", "event_id")
    return tables.latest_status(log, "user_id")


# What an event does to its user's resume.
STEP = "case event_type when 'signup' then 'UPLOADED' when 'click' then 'PARSED' when 'error' then 'FAILED' else 'PROCESSING' end"
LEGAL = ", ".join(f"'{state}>{step}'" for state, after in lifecycle.RESUME.items() for step in after)


@query(
    "life_cycle_u11",
    f"""with l as (select user_id, list({{'s': {STEP}, 'ok': 0::bigint, 'bad': 0::bigint}} order by ts, event_id) as steps from events group by user_id),
        r as (select user_id, list_reduce(list_prepend({{'s': '', 'ok': 0::bigint, 'bad': 0::bigint}}, steps), lambda a, x:
            case when concat(a.s, '>', x.s) in ({LEGAL}) then {{'s': x.s, 'ok': a.ok + 1, 'bad': a.bad}}
                 else {{'s': a.s, 'ok': a.ok, 'bad': a.bad + 1}} end) as f from l)
        select user_id, f.s as state, f.ok as steps, f.bad as rejected from r""",
)
def life_cycle(load):
    log = load("events").select("user_id", F.expr(STEP).alias("status"), "ts", "event_id")
    order = ["ts", "event_id"]
    return lifecycle.current(lifecycle.steps(log, "user_id", lifecycle.RESUME, order), "user_id", order)


@query(
    "new_users_u12",
    """with l as (select event_id, lower(trim(concat(' User', user_id * 20, '@Example.com '))) as email, user_id, event_type from events),
       f as (select email, min_by(case when event_type = 'signup' then concat('user', user_id * 20) else event_type end, event_id) as display_name
         from l group by email)
       select sha256(email) as user_id, email, display_name, 'PRIVATE' as profile_visibility from f
       where email not in (select email from v_users)""",
)
def new_users(load):
    logins = load("events").select(
        F.concat(F.lit(" User"), (F.col("user_id") * 20).cast("string"), F.lit("@Example.com ")).alias("email"),
        F.when(F.col("event_type") == "signup", F.lit(" ")).otherwise(F.col("event_type")).alias("name"),
        F.col("event_id").alias("login_id"),
    )
    return tables.find_or_create_users(load("v_users"), logins)
