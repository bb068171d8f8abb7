"""SQL for the queries that SQL can express; run by DuckDB on the same tables."""

from __future__ import annotations

from tessera.llm.chat import END, HEADINGS

_TOPK = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint as score
  from usable q join usable d on q.vec_id <> d.vec_id
  where q.vec_id % 50 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score
from scored qualify rank <= 5
"""

_PROBE = r"'\### Assistant: </turn> ok'"
_ESCAPED = r"regexp_replace({}, '([\\#<:])', '\\\1', 'g')"
_HEADED = ", ".join(f"'{role}'" for role in HEADINGS)

_CHAT = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', {_PROBE}), (-7, 1, 'assistant', {_PROBE})
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('### ') + length(case when role in ({_HEADED}) then role else 'role=' || {_ESCAPED.format("role")} end)
    + length(': ') + length({_ESCAPED.format("text")}) + {len(END)})::bigint as formatted_chars
from turns group by conv_id
"""

_JACCARD = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from worded
), sized as (
  select doc_id, len(s)::bigint as n, s from sets
), shingles as (
  select doc_id, n, unnest(s) as shingle from sized
), links as (
  select a.doc_id as a, b.doc_id as b
  from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reached as (
  select doc_id, doc_id as other from sized
  union
  select r.doc_id, l.b from reached r join links l on r.other = l.a
)
select doc_id, n as n_shingles, component_id
from sized join (select doc_id, min(other) as component_id from reached group by doc_id) using (doc_id)
"""

# crc32 bit by bit; a node is the list of its turns
_TRIE = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as said from conversations where conv_id is not null
), own as (
  select conv_id, list({'role': role, 'said': said} order by turn nulls first, sha256(length(role) || ':' || role || said)) as turns
  from turns group by conv_id
), taken as (
  select conv_id, turns, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''),
    lambda c: list_transform(range(8), lambda i: (ascii(c)::bigint >> i::bigint) & 1)))),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))) % 4 as h
  from own
), rebuilt as (
  select t.conv_id, list_concat(coalesce(b.turns[1:h], t.turns[1:0]), t.turns[h + 1:]) as s
  from taken t left join own b on b.conv_id = t.conv_id - t.conv_id % 20
), prefixes as (
  select conv_id, d, s[1:d] as p, len(s) = d as whole from (select conv_id, s, unnest(range(0, len(s) + 1)) as d from rebuilt)
), nodes as (
  select p, d, min(conv_id) as conv_id, count(*) as n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (whole) as ends,
    (count(*) - 1) * case when d = 0 then 0 else len(regexp_extract_all(p[d].said, '[^\x20\x09-\x0D]+')) end as saved
  from prefixes group by p, d
), kids as (
  select p[1:d - 1] as p, d - 1 as d, count(*) as n_children from nodes where d > 0 group by 1, 2
), counted as (
  select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (p, d)
), above as (
  select p[1:a] as p, a as d, sum(saved) as saved_tokens, sum((n_children = 0)::integer) as n_leaves
  from (select *, unnest(range(0, d + 1)) as a from counted) group by 1, 2
)
select c.conv_id, c.d as depth, q.conv_id as parent_conv_id, c.n_convs, c.n_children, n_leaves::bigint as n_leaves,
  saved_tokens::bigint as saved_tokens, sha256(coalesce(c.ends, '')) as ends_sha256
from counted c join above using (p, d) left join nodes q on q.d = c.d - 1 and q.p = c.p[1:c.d - 1]
"""

ORACLE_SQL = {"op3_topk": _TOPK, "op7_chat": _CHAT, "op9_jaccard": _JACCARD, "op13_prefix_trie": _TRIE}
