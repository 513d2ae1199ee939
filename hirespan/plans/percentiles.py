"""Applicant counts, percentiles and leaderboards."""

from pyspark.sql import functions as F

from hirespan.operators import percentile as pct
from hirespan.plans.registry import query


@query(
    "arrival_percentile_w4_w7",
    """with ranked as (
         select *, list(match_score) over (partition by job_id order by scored_at, application_id
           rows between unbounded preceding and 1 preceding) as earlier from v_scores),
       counted as (select * exclude (earlier), len(coalesce(earlier, [])) as n,
           len(list_filter(coalesce(earlier, []), lambda s: s <= match_score)) as le from ranked)
       select application_id, user_id, job_id, scored_at, match_score, cast(n + 1 as bigint) as applicant_count,
         case when n < 4 then 'EARLY_APPLICANT' else 'PERCENTILE_READY' end as benchmark_state,
         case when n < 4 then null else cast(floor(100.0 * le / n + 0.5) as int) end as percentile
       from counted""",
)
def arrival_percentile(load):
    return pct.arrival_percentile(load("v_scores"))


@query(
    "snapshot_percentile_w5",
    """select application_id, job_id, match_score,
         cume_dist() over (partition by job_id order by match_score) as cume_dist,
         cast(floor(100e0 * count(*) over (partition by job_id order by match_score
           range between unbounded preceding and current row)
           / count(*) over (partition by job_id) + 0.5e0) as int) as percentile,
         count(*) over (partition by job_id) as applicant_count
       from v_scores""",
)
def snapshot_percentile(load):
    return pct.snapshot_percentile(load("v_scores"))


@query(
    "scored_applicants_a1",
    "select job_id, count(*) as applicant_count from v_scores group by job_id",
)
def scored_applicants(load):
    return pct.scored_applicants(load("v_scores"))


@query(
    "percentile_of_score_a2",
    """select p.p_partkey * 2 as job_id, cast(p.p_size * 2 as int) as probe_score,
         coalesce(cast(floor(count(*) filter (s.match_score <= p.p_size * 2) * 100e0
           / nullif(count(s.match_score), 0) + 0.5e0) as int), 50) as percentile
       from part p left join v_scores s on s.job_id = p.p_partkey * 2
       group by p.p_partkey, p.p_size""",
)
def percentile_of(load):
    # The upper half of these job ids has no applicants, which shows the default.
    probes = load("part").select(
        (F.col("p_partkey") * 2).alias("job_id"), (F.col("p_size") * 2).cast("int").alias("probe_score")
    )
    return pct.percentile_of(load("v_scores"), probes)


@query(
    "leaderboard_w8",
    """select job_id, application_id, match_score,
         cast(rank() over (partition by job_id order by match_score desc) as bigint) as position
       from v_scores""",
)
def leaderboard(load):
    return pct.leaderboard(load("v_scores"))
