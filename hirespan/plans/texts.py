"""Text clean-up, skills in texts, matching, stored responses."""

from pyspark.sql import functions as F

from hirespan.functions import records, text
from hirespan.operators import feed, skills
from hirespan.operators.skew import spread
from hirespan.plans.registry import query

# White space of every kind, as the SQL side writes it.
SPACE = r"[\s\v\x{85}\p{Z}]+"
# The invented prose holds hardly any of the default keywords, so these common words stand in.
WORDS = ["the", "und", "les", "que", "rest", "ai", "en la", "c++"]
REQUIRED, PREFERRED = ["with", "pour"], ["les", "der ", "los"]


def _skill_sql(keywords, required, preferred) -> str:
    words = ", ".join(f"('{w}', '{_quoted(w)}')" for w in keywords)
    has = lambda cues: " or ".join(f"contains(line, '{c}')" for c in cues)
    return f"""
      with k(skill, pattern) as (values {words}),
      lines as (select doc_id, unnest(string_split(lower(text), chr(10))) as line from documents),
      marked as (select doc_id, line, not ({has(required)}) and ({has(preferred)}) as soft from lines),
      hits as (select doc_id, skill, bool_or(not soft) as is_required from marked, k
        where contains(line, skill) and regexp_matches(line, pattern) group by 1, 2)
      select d.doc_id as job_id,
        coalesce(string_agg(skill, ',' order by skill) filter (is_required), '') as required_skills,
        coalesce(string_agg(skill, ',' order by skill) filter (not is_required), '') as preferred_skills
      from documents d left join hits h on h.doc_id = d.doc_id group by d.doc_id"""


def _quoted(word: str) -> str:
    return r"\b" + word.replace("+", r"\+") + r"\b"


def _skills(load, **options):
    # The given files are a single row group each.
    found = skills.requirement_profiles(spread(load("v_text_jobs").select("job_id", "description_text")), **options)
    return found.select(
        "job_id",
        F.array_join("required_skills", ",").alias("required_skills"),
        F.array_join("preferred_skills", ",").alias("preferred_skills"),
    )


@query("skill_extraction_p1", _skill_sql(text.SKILL_KEYWORDS, text.REQUIRED_CUES, text.PREFERRED_CUES))
def skill_extraction(load):
    return _skills(load)


@query("skill_sets_p1_a11_u2", _skill_sql(WORDS, REQUIRED, PREFERRED))
def skill_sets(load):
    return _skills(load, keywords=WORDS, required_cues=REQUIRED, preferred_cues=PREFERRED)


MATCH_SQL = """
  with prof as (
    select conv_id, conv_id * 1000 + turn as user_id, list_distinct(list_filter(list_transform(string_split(text, ' '),
      lambda s: lower(regexp_replace(s, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'))), lambda s: s <> '')) as skills
    from conversations)
"""


def _profiles(load):
    """Every turn of a conversation stands for a profile, its words for the skills."""
    user = (F.col("conv_id") * 1000 + F.col("turn")).alias("user_id")
    return load("conversations").select(user, F.split("text", " ").alias("skills"), "conv_id")


@query(
    "pair_match_j7_p2",
    MATCH_SQL
    + """select p.user_id, d.doc_id as job_id,
         cast(floor(len(list_filter(p.skills, lambda s: contains(lower(d.text), s))) / cast(len(p.skills) as double)
           * 100e0 + 0.5e0) as int) as match_percentage
       from documents d join prof p on p.conv_id = d.n_chars % (select max(conv_id) + 1 from prof)""",
)
def pair_match(load):
    profiles = _profiles(load)
    total = profiles.agg(F.max("conv_id") + 1).scalar()
    jobs = load("documents").select(F.col("doc_id").alias("job_id"), (F.col("n_chars") % total).alias("conv_id"))
    pairs = jobs.join(profiles.select("conv_id", "user_id"), "conv_id").select("user_id", "job_id")
    return skills.pair_match(pairs, profiles, load("v_text_jobs"))


@query(
    "feed_match_p2",
    MATCH_SQL
    + """, one as (select * from prof order by user_id desc limit 1)
       select d.doc_id as job_id, d.source as company, cast(floor(len(list_filter(p.skills,
           lambda s: contains(lower(d.text), s))) / cast(len(p.skills) as double) * 100e0 + 0.5e0) as int) as match_percentage
       from documents d, one p""",
)
def feed_match(load):
    # The feed as one user sees it: the newest profile against every posting.
    profile = _profiles(load).orderBy(F.col("user_id").desc()).limit(1)
    shown = feed.with_match(load("v_text_jobs"), profile)
    return shown.select("job_id", "company", "match_percentage")


@query(
    "strip_tags_p15",
    f"select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '{SPACE}', ' ', 'g')) as content from pages",
)
def strip_tags(load):
    return load("pages").select("page_id", text.strip_tags(F.col("html")).alias("content"))


UNESCAPED = "{c}"
for _entity, _character in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "''")]:
    UNESCAPED = f"replace({UNESCAPED}, '{_entity}', '{_character}')"
UNESCAPED = f"replace(replace({UNESCAPED}, '&nbsp;', chr(160)), '&amp;', '&')"


@query(
    "clean_cells_p16",
    f"""with cells as (select page_id, unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) as c,
          generate_subscripts(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), 1) as n from pages)
        select page_id, cast(n - 1 as int) as position, trim(regexp_replace(replace({UNESCAPED.format(
          c="regexp_replace(regexp_replace(c, '(?i)<br\\s*/?>', ', ', 'g'), '(?s)<[^>]+>', '', 'g')")},
          '🔥', ''), '{SPACE}', ' ', 'g')) as content from cells""",
)
def clean_cells(load):
    cells = F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))
    rows = load("pages").select("page_id", F.posexplode(cells).alias("position", "_cell"))
    return rows.select("page_id", "position", text.clean_cell(F.col("_cell")).alias("content"))


@query(
    "clean_pages_p16",
    f"""with bare as (select page_id, regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', ', ', 'g'), '(?s)<[^>]+>', '', 'g') as c from pages),
        named as (select page_id, regexp_replace(regexp_replace(regexp_replace(c, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g') as c from bare)
        select page_id, trim(regexp_replace(replace(regexp_replace(c, '&amp;?', '&', 'g'), '🔥', ''), '{SPACE}', ' ', 'g')) as content from named""",
)
def clean_pages(load):
    """Whole pages taken as one cell."""
    return load("pages").select("page_id", text.clean_cell(F.col("html")).alias("content"))


@query(
    "apply_links_s3",
    f"""with found as (select page_id, unnest(regexp_extract_all(html, 'href="(https?://[^"]+)"', 1)) as link,
            generate_subscripts(regexp_extract_all(html, 'href="(https?://[^"]+)"', 1), 1) as n from pages),
        good as (select page_id, n, {UNESCAPED.format(c='link')} as link from found),
        kept as (select page_id, min_by(link, n) as link from good
          where link not like '%simplify.jobs/p/%' and link not like '%simplify.jobs/c/%' group by page_id)
        select p.page_id, coalesce(k.link, '') as apply_url from pages p left join kept k using (page_id)""",
)
def apply_links(load):
    return load("pages").select("page_id", text.apply_link(F.col("html")).alias("apply_url"))


@query(
    "content_hashes_p17",
    """select doc_id, sha256(text) as description_hash, sha256(concat('https://jobs.example.com/', source, '/', doc_id)) as source_key
       from documents""",
)
def content_hashes(load):
    url = F.concat(F.lit("https://jobs.example.com/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return load("documents").select(
        "doc_id", text.content_hash(F.col("text")).alias("description_hash"), text.content_hash(url).alias("source_key")
    )


FENCED = """case role when 'user' then concat('```json', chr(10), text, chr(10), '```')
  when 'assistant' then concat(' ```', text, '``` ') end"""
TRIMMED = r"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@query(
    "strip_fences_p18",
    f"""with f as (select conv_id, turn, role, {TRIMMED.format(c=FENCED)} as t from conversations),
        g as (select *, case when strpos(t, chr(10)) > 0 then substr(t, strpos(t, chr(10)) + 1) else t end as o from f)
        select conv_id, turn,
          case when t is null then '{{}}' else {TRIMMED.format(
            c="case when ends_with(o, '```') then substr(o, 1, length(o) - 3) else o end")} end as body,
          case when t is null then '{{}}' else {TRIMMED.format(
            c="regexp_replace(regexp_replace(t, '^```[a-zA-Z]*' || chr(10) || '?', ''), '```$', '')")} end as bare
        from g""",
)
def strip_fences(load):
    fenced = F.expr(FENCED.replace("chr(10)", "'\\n'"))
    return load("conversations").select(
        "conv_id", "turn", text.strip_fence(fenced).alias("body"), text.strip_fence_marks(fenced).alias("bare")
    )


CATEGORIES = {"red": "Languages", "blue": "Frameworks", "small": "Infrastructure", "old": "Databases", "hot": "Concepts"}
CATEGORY_SQL = "case {s} " + " ".join(f"when '{k}' then '{v}'" for k, v in CATEGORIES.items()) + " else 'Other' end"
POSITION_SQL = "case {s} " + " ".join(
    f"when '{k}' then {skills.CATEGORY_ORDER.index(v)}" for k, v in CATEGORIES.items()
) + " else 5 end"


@query(
    "skill_tree_a10_p27",
    f"""with w as (
          select a.application_id, list_distinct(list_concat(string_split(lower(q.required_text), ' '),
              coalesce(list_transform(string_split(q.preferred_text, ','), lambda s: lower(trim(s))), []))) as wanted,
            string_split(p.skills_text, ',') as have
          from v_applications a join v_requirements q using (job_id) join v_profiles p using (resume_id)),
        s as (select application_id, have, wanted, unnest(wanted) as skill from w)
        select application_id,
          cast(len(list_filter(any_value(wanted), lambda x: list_contains(any_value(have), x))) as int) as match_count,
          cast(len(any_value(wanted)) as int) as total_count,
          cast(floor(len(list_filter(any_value(wanted), lambda x: list_contains(any_value(have), x)))
            / cast(len(any_value(wanted)) as double) * 100e0 + 0.5e0) as int) as percentage,
          {POSITION_SQL.format(s='skill')} as category_position, {CATEGORY_SQL.format(s='skill')} as category,
          cast(count(*) as int) as wanted, cast(count(*) filter (list_contains(have, skill)) as int) as matched
        from s group by application_id, category_position, category""".replace(
        "any_value(wanted)", "min(wanted)"
    ).replace("any_value(have)", "min(have)"),
)
def skill_tree(load):
    wanted = load("v_requirements").select(
        "job_id",
        F.split("required_text", " ").alias("required_skills"),
        F.split("preferred_text", ",").alias("preferred_skills"),
    )
    have = load("v_profiles").select("resume_id", F.split("skills_text", ",").alias("user_skills"))
    rows = load("v_applications").select("application_id", "job_id", "resume_id").join(wanted, "job_id").join(have, "resume_id")
    return skills.skill_tree(rows, ["application_id"], CATEGORIES)


# Stored responses made from orders: numbers as numbers or text, some missing, some too large,
# some texts in fences, and those of low priority broken by a lost last character.
SCORE = "cast(floor(o_totalprice) as bigint) % 140"


def _responses(load, body):
    orders = spread(load("orders"))
    score = F.expr(SCORE)
    numbered = orders.withColumn("score", score)
    whole = F.to_json(body)
    broken = F.when(F.col("o_orderpriority") == "5-LOW", F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    fenced = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("```json\n"), broken, F.lit("\n```"))).otherwise(broken)
    return numbered.select(F.col("o_orderkey").alias("response_id"), fenced.alias("response"))


@query(
    "analysis_records_p19",
    f"""select o_orderkey as response_id,
          cast(case when o_orderstatus = 'P' then 50 else least(100, {SCORE}) end as int) as overall_score,
          cast(case when o_orderstatus = 'F' then least(100, {SCORE}) else 50 end as int) as ats_score,
          concat(o_orderstatus, '|null|7') as strengths, cast(least(100, {SCORE}) as int) as experience,
          cast(50 as int) as projects, concat('Fix ', o_orderstatus) as first_bullet, cast(50 as int) as first_bullet_score,
          case when o_orderstatus = 'O' then 'Analysis complete.' else o_orderstatus end as verdict,
          concat('A:', o_orderstatus) as take, cast(o_custkey as varchar) as parsed_name
        from orders where o_orderpriority <> '5-LOW'""",
)
def analysis_records(load):
    score, status = F.col("score"), F.col("o_orderstatus")
    body = F.struct(
        F.when(status != "P", score.cast("string")).alias("overall_score"),
        F.when(status == "F", score).alias("ats_score"),
        F.parse_json(F.concat(F.lit('["'), status, F.lit('", null, 7]'))).alias("strengths"),
        F.struct(score.alias("experience"), F.lit("no number").alias("projects")).alias("section_scores"),
        F.array(F.struct(F.concat(F.lit("Fix "), status).alias("original"))).alias("bullet_feedback"),
        F.when(status != "O", status).alias("summary_verdict"),
        F.array(F.struct(F.lit("A").alias("grade"), F.array(status).alias("red_flags"))).alias("recruiter_take"),
        F.struct(F.col("o_custkey").alias("name")).alias("ats_parsed_sections"),
    )
    read, _ = records.parse_analyses(_responses(load, body))
    return read.select(
        "response_id",
        "overall_score",
        "ats_score",
        F.array_join("strengths", "|").alias("strengths"),
        F.col("section_scores")["experience"].alias("experience"),
        F.col("section_scores")["projects"].alias("projects"),
        F.get("bullet_feedback", F.lit(0))["original"].alias("first_bullet"),
        F.get("bullet_feedback", F.lit(0))["score"].alias("first_bullet_score"),
        F.col("summary_verdict").alias("verdict"),
        F.concat_ws(":", F.get("recruiter_take", F.lit(0))["grade"], F.get("recruiter_take", F.lit(0))["red_flags"]).alias("take"),
        F.col("ats_parsed_sections")["name"]["text"].alias("parsed_name"),
    )


@query(
    "analysis_sections_p19",
    f"""with r as (select * from orders where o_orderpriority <> '5-LOW' and o_orderstatus <> 'P')
        select o_orderkey as response_id, 'name' as section, cast(o_custkey as varchar) as text, null as items,
          case when o_orderstatus = 'F' then '' else 'Analysis complete.' end as verdict from r
        union all select o_orderkey, 'skills', null, concat(o_orderstatus, '|null||7'), case when o_orderstatus = 'F' then '' else 'Analysis complete.' end from r
        union all select o_orderkey, 'dates', '', null, case when o_orderstatus = 'F' then '' else 'Analysis complete.' end from r
        union all select o_orderkey, 'nothing', '', null, case when o_orderstatus = 'F' then '' else 'Analysis complete.' end from r
        union all select o_orderkey, 'empty', null, '', case when o_orderstatus = 'F' then '' else 'Analysis complete.' end from r""",
)
def analysis_sections(load):
    """Sections of every shape; where they are no object, as for one status, there are none."""
    status = F.col("o_orderstatus")
    sections = F.concat(
        F.lit('{"name":'), F.col("o_custkey").cast("string"), F.lit(',"skills":["'), status,
        F.lit('",null,{"a":1},7],"dates":{"from":1,"to":[2]},"nothing":null,"empty":[]}'),
    )
    body = F.struct(
        F.parse_json(F.when(status == "P", F.lit('["no object"]')).otherwise(sections)).alias("ats_parsed_sections"),
        F.parse_json(F.when(status == "F", F.lit('{"nested":"verdict"}'))).alias("summary_verdict"),
    )
    read, _ = records.parse_analyses(_responses(load, body))
    each = read.select("response_id", F.explode("ats_parsed_sections").alias("section", "_v"), "summary_verdict")
    return each.select(
        "response_id", "section", F.col("_v.text").alias("text"), F.array_join("_v.items", "|").alias("items"),
        F.col("summary_verdict").alias("verdict"),
    )


@query(
    "fit_records_p20",
    f"""select o_orderkey as response_id, case when o_orderpriority = '5-LOW' then null
          else cast(case when o_orderstatus = 'P' then 50 else least(100, {SCORE}) end as int) end as fit_score,
          case when o_orderpriority <> '5-LOW' then concat(o_orderstatus, '|', o_orderpriority) end as matched_skills,
          case when o_orderpriority <> '5-LOW' then 0 end as missing_count,
          case when o_orderpriority <> '5-LOW' then 'Analysis complete.' end as fit_summary,
          case when o_orderpriority = '5-LOW' then 'unreadable response' end as reason from orders""",
)
def fit_records(load):
    status = F.col("o_orderstatus")
    body = F.struct(
        F.when(status != "P", F.col("score")).alias("fit_score"),
        F.array(status, F.col("o_orderpriority")).alias("matched_skills"),
        F.lit("not a list").alias("missing_skills"),
    )
    read, rejects = records.parse_fits(_responses(load, body))
    return read.select(
        "response_id",
        "fit_score",
        F.array_join("matched_skills", "|").alias("matched_skills"),
        F.size("missing_skills").alias("missing_count"),
        "fit_summary",
    ).unionByName(rejects.select("response_id", "reason"), allowMissingColumns=True)


@query(
    "profile_records_p21",
    """select o_orderkey as response_id,
         case when o_orderpriority = '5-LOW' then '' else concat(o_orderstatus, '|', o_orderpriority) end as skills,
         case when o_orderpriority = '5-LOW' or o_orderstatus = 'P' then null else cast(o_custkey % 12 as int) end as years_experience,
         case when o_orderpriority <> '5-LOW' and o_orderstatus = 'F' then 'MASTERS' end as education_level, 'PARSED' as status
       from orders""",
)
def profile_records(load):
    status = F.col("o_orderstatus")
    body = F.struct(
        F.array(status, F.col("o_orderpriority")).alias("skills"),
        F.when(status != "P", F.col("o_custkey") % 12).alias("yearsExperience"),
        F.when(status == "F", "MASTERS").alias("educationLevel"),
    )
    read, _ = records.parse_profiles(_responses(load, body))
    return read.withColumn("skills", F.array_join("skills", "|"))


@query(
    "roast_records_p22",
    f"""with r as (select o_orderkey as response_id, o_orderstatus,
            cast(case when o_orderstatus = 'P' then 50 else least(100, {SCORE}) end as int) as top_dog_rank
          from orders where o_orderpriority not in ('5-LOW', '1-URGENT'))
        select response_id, concat('Roast ', o_orderstatus) as roast_text, o_orderstatus as missing_dependencies, top_dog_rank,
          case when top_dog_rank >= 90 then 'ALPHA_DOG' when top_dog_rank >= 75 then 'GOOD_BOY' when top_dog_rank >= 60
            then 'FETCH_PLAYER' when top_dog_rank >= 40 then 'HOUSE_TRAINED' when top_dog_rank >= 20 then 'LOST_PUPPY'
            else 'POUND_CANDIDATE' end as tier_name from r""",
)
def roast_records(load):
    status = F.col("o_orderstatus")
    body = F.struct(
        F.concat(F.lit("Roast "), status).alias("brutal_roast_text"),
        F.array(status).alias("missing_dependencies"),
        F.when(status != "P", F.col("score")).alias("top_dog_rank"),
    )
    # Fences are not removed from roasts, so fenced texts are rejected too.
    read, _ = records.parse_roasts(_responses(load, body))
    return read.withColumn("missing_dependencies", F.array_join("missing_dependencies", "|"))
