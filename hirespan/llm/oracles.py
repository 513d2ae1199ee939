"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from hirespan.llm.centroids import CENTROIDS, ROUNDS, SCALE, SEED, SIZE
from hirespan.llm.quality import MIN_WORDS, MOST_REPEATED, RULES, STOP_WORDS

ORACLES: dict[str, str] = {}
WS = r"[\x20\x09-\x0D]"
NWS = r"[^\x20\x09-\x0D]"


def _rules() -> str:
    parts = []
    for r in RULES:
        whole = f"greatest({r.whole}, 1)"
        if r.low > 0:
            parts.append(f"{r.part} >= {r.low}::double * {whole}")
        if r.high < float("inf"):
            parts.append(f"{r.part} <= {r.high}::double * {whole}")
    return " and ".join(parts)


_STOP = ", ".join(f"'{form}'" for form in sorted({f for w in STOP_WORDS for f in (w, w.capitalize())}))

ORACLES["op2_quality_rules"] = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{NWS}')) as lines from t),
win as (select doc_id, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
        from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from win) where n > 1),
cov as (select doc_id, count(distinct p) as n_repeat_words
        from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by doc_id),
m as (select doc_id, len(words)::bigint as n_words,
             length(regexp_replace(text, '{WS}+', '', 'g'))::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::bigint as n_symbols,
             (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines)::bigint as n_lines,
             (length(text) - length(regexp_replace(text, '[!?]+', '', 'g')))::bigint as n_loud,
             len(list_filter(words, lambda x: x in ({_STOP})))::bigint as n_stop,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from w left join cov using (doc_id)),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from m)
select *, not base_failed and {_rules()} as kept from f
"""

_REST = r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://((?s:.*))$', 1)"
ORACLES["op3_url_filter"] = rf"""
with r as (select page_id, {_REST} as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
j as (select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from p)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from j
"""

_TEXT = r"regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')"
_ROLE = r"regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')"
ORACLES["op8_chat_format"] = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok'
           union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, '### ' || {_ROLE} || ': ' || {_TEXT} || ' </turn>' || chr(10) as line from t)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, line)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, line), '')) as loss_sha256,
       sum(length(line))::bigint as formatted_chars
from e group by conv_id
"""

ORACLES["op1_near_duplicates"] = f"""
with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '{WS}+'), lambda x: x <> '') as words from documents),
s as (select doc_id, unnest(case when len(words) = 0 then [] when len(words) = 1 then [words[1]]
        else list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
f as (select shingle, count(*) as df from s group by shingle),
r as (select s.doc_id, shingle, n, row_number() over (partition by s.doc_id order by df, shingle) as place
      from s join f using (shingle) join n using (doc_id)),
p as (select * from r where place <= n - ceil(0.8 * n) + 1),
c as (select distinct x.doc_id as a, y.doc_id as b from p x join p y on x.shingle = y.shingle and x.doc_id < y.doc_id),
k as (select a, b, count(*) as shared from c join s x on x.doc_id = a join s y on y.doc_id = b and y.shingle = x.shingle group by a, b),
l as (select a, b from k join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l),
reach as (select a as doc_id, b as other from e union select reach.doc_id, e.b from reach join e on e.a = reach.other),
m as (select doc_id, min(other) as low from reach group by doc_id)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) as component_id,
       w.doc_id = least(w.doc_id, coalesce(low, w.doc_id)) as kept
from w left join n using (doc_id) left join m using (doc_id)
"""


def _rounds() -> str:
    """Assignment a0 to centroids c0, their means c1, and so on."""
    parts = []
    for k in range(ROUNDS + 1):
        parts.append(f"""
d{k} as (select v.row, v.vec_id, v.v, c.cluster, c.c, list_sum(list_transform(range(1, {SIZE} + 1), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))::bigint as distance
        from vectors v cross join c{k} c),
a{k} as (select row, any_value(vec_id) as vec_id, any_value(v) as v, arg_min(cluster, distance * 64 + cluster) as cluster, min(distance) as distance from d{k} group by row),
s{k} as (select cluster, i, sum(v[i])::bigint as s, count(*)::bigint as n from a{k}, (select unnest(range(1, {SIZE} + 1)) as i) group by cluster, i),
m{k} as (select cluster, list((s - ((s % n) + n) % n) // n order by i) as c from s{k} group by cluster),
c{k + 1} as (select c.cluster, coalesce(m.c, c.c) as c from c{k} c left join m{k} m using (cluster))""")
    return ",".join(parts)


ORACLES["op12_centroid_clusters"] = f"""
with whole as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
    where len(embedding) = {SIZE} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {SIZE}),
vectors as (select row_number() over () as row, * from whole),
c0 as (select (row_number() over (order by sha256('{SEED}:' || vec_id), v) - 1)::int as cluster, v as c from vectors
       where vec_id is not null qualify cluster < {CENTROIDS}),
{_rounds()},
t as (select cluster, sum(distance)::bigint as cluster_inertia from a{ROUNDS} group by cluster)
select vec_id, cluster, distance, cluster_inertia, (select sum(cluster_inertia) from t)::bigint as inertia,
       sha256(array_to_string(c, ',')) as centroid_sha256
from a{ROUNDS} join t using (cluster) join c{ROUNDS} using (cluster)
"""


def _f(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar))::varchar || ':' || {value}::varchar, '-')"


_RECORD = " || ".join(_f(c) for c in ["doc_id", "source", "lang", "n_chars", "text"])
# A byte is taken in by one step and eight shifts.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''),
    lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end))"""


def _tree(prefix: str, leaves: str) -> str:
    """Nodes of the trees over ``leaves`` (tree, lo, digest), and the path of each leaf as the list of its siblings."""
    return f"""
{prefix}_size as (select tree, count(*) as n from {leaves} group by tree),
{prefix}_node(tree, level, lo, digest, n) as (
    select tree, 0, lo, digest, n from {leaves} join {prefix}_size using (tree)
    union all
    select tree, any_value(level) + 1, lo // 2, sha256(string_agg(digest, '' order by lo)), (any_value(n) + 1) // 2
    from {prefix}_node where n > 1 group by tree, lo // 2),
{prefix}_path(tree, leaf, level, lo, sides) as (
    select tree, lo, 0, lo, []::varchar[] from {leaves}
    union all
    select p.tree, leaf, p.level + 1, p.lo // 2,
           list_append(sides, coalesce(case when s.lo < p.lo then 'L' else 'R' end || s.digest, ''))
    from {prefix}_path p join {prefix}_node o on o.tree = p.tree and o.level = p.level and o.lo = p.lo and o.n > 1
         left join {prefix}_node s on s.tree = p.tree and s.level = p.level and s.lo = xor(p.lo, 1)),
{prefix}_top as (select tree, digest from {prefix}_node where n = 1),
{prefix}_end as (select tree, leaf, arg_max(sides, level) as sides from {prefix}_path group by tree, leaf)"""


ORACLES["op13_merkle_manifest"] = f"""
with recursive r as (
    select doc_id, coalesce('=' || lang, '') as tree, sha256({_RECORD}) as digest,
           case when {_CRC} % 7 = 0 then sha256({_RECORD.replace("n_chars", "(n_chars::hugeint + 1)")}) end as tampered from documents),
leaf as (select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as lo from r),
{_tree("a", "leaf")},
sub as (select '' as tree, row_number() over (order by encode(tree)) - 1 as lo, digest, tree as name from a_top),
{_tree("b", "sub")},
whole as (select l.doc_id, l.digest as leaf, s.digest as subroot, t.digest as root, list_concat(e.sides, u.sides) as sides, l.tampered
          from leaf l join a_end e on e.tree = l.tree and e.leaf = l.lo join sub s on s.name = l.tree
               join b_end u on u.leaf = s.lo cross join b_top t),
f as (select *, list_reduce(list_prepend(coalesce(tampered, leaf), sides), lambda x, s: sha256(case
          when starts_with(s, 'L') then s[2:] || x when starts_with(s, 'R') then x || s[2:] else x end)) as folded_root from whole)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(sides, lambda s: s[2:]), '')) as proof_sha256,
       folded_root, folded_root = root as verified from f
"""
