"""SQL (DuckDB) that gives the same rows as the queries that can be said in it."""

from __future__ import annotations

from .chat import ADDED, END, START

#: A word: a run of characters other than ASCII white space.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _escaped(x: str) -> str:
    return f"replace(replace({x}, '\\', '\\\\'), '<|', '<\\|')"


OP1 = """
with recursive e as (
  select vec_id, label, embedding::double[] v from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding::double[], lambda x: x <> 0)) > 0
), l as (
  select a.vec_id a, b.vec_id b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_inner_product(a.v, b.v) >= 0.98 * sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))
), r(a, b) as (
  select a, b from l union select r.a, l.b from r join l on r.b = l.a
), n as (select a, count(*) links from l group by a), c as (select a, min(b) least from r group by a)
select vec_id, coalesce(links, 0)::bigint n_links, least(vec_id, coalesce(c.least, vec_id)) component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
"""

OP5 = f"""
with recursive w as (select doc_id, {_WORDS} ws from documents),
s as (
  select doc_id, list_sort(list_distinct(case when len(ws) < 5 then [hash(ws)]
    else list_transform(range(1, len(ws) - 3), lambda i: hash(ws[i:i + 4])) end)) g
  from w where len(ws) > 0
), cl as (select g, min(doc_id) id, count(*) copies, len(g) n from s group by g),
x as (select id, n, unnest(g) t from cl),
p as (
  select a.id a, b.id b from x a join x b on a.t = b.t and a.id < b.id and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  group by a.id, b.id, a.n, b.n having 5 * count(*) >= 4 * (a.n + b.n - count(*))
), l as (select a, b from p union all select b, a from p),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) least from r group by a),
n as (select l.a, sum(cl.copies) links from l join cl on cl.id = l.b group by l.a),
o as (
  select s.doc_id, cl.id class_id, (coalesce(n.links, 0) + cl.copies - 1)::bigint n_links, least(cl.id, coalesce(c.least, cl.id)) component_id
  from s join cl on cl.g = s.g left join n on n.a = cl.id left join c on c.a = cl.id
)
select d.doc_id, coalesce(o.class_id, d.doc_id) class_id, coalesce(o.n_links, 0)::bigint n_links, coalesce(o.component_id, d.doc_id) component_id,
  d.doc_id = coalesce(o.component_id, d.doc_id) kept
from documents d left join o on o.doc_id = d.doc_id
"""

OP8 = f"""
with t as (
  select conv_id::bigint conv_id, turn::bigint turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all values (-1, 0, 'user', '{ADDED}'), (-1, 1, 'assistant', '{ADDED}')
)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x)) turns_sha256,
  coalesce(sum(length(x)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(x, '' order by turn nulls first, r, x) filter (r = 'assistant'), '')) loss_sha256,
  sum({len(START) + len(END) + 2} + length(replace({_escaped('r')}, chr(10), '\\n')) + length({_escaped('x')}))::bigint formatted_chars, false rewrites_history
from t group by conv_id
"""

OP12 = r"""
with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') text from documents),
w as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) x from d),
l as (select id, lang, source, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t, count(*) n from w group by all),
k as (select lang, t, sum(n) total from l group by lang, t having count(*) >= 30),
s as (select lang, count(*) v, sum(total) m from k group by lang),
c as (select l.lang, l.source, l.t, sum(n) n from l join k on k.lang = l.lang and k.t = l.t group by l.lang, l.source, l.t),
g as (select x.lang, x.source, coalesce(sum(c.n), 0) m from (select distinct lang, source from d) x left join c on c.lang = x.lang and c.source = x.source group by x.lang, x.source),
p as (
  select g.lang, g.source, k.t, coalesce(c.n, 0) n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.m + 5 * s.v) p, 1 + (1000000000 * (k.total + 5)) // (s.m + 5 * s.v) q
  from g join s on s.lang = g.lang join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.t = k.t
),
f as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by a.lang, a.source, b.source),
r as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(f.f, 0)::bigint value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', t, (p - q)::bigint from p where n > 0 and p > q
)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int rank
from r qualify part = 'pair' or rank <= 50
"""

OP13 = """
with p as (select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) n from pages),
g as (select h, max(page_id) r from p where n >= 1000 group by h)
select page_id, n::bigint payload_bytes, sha1(p.h) payload_digest, case when page_id is distinct from coalesce(r, page_id) then 'revisit' else 'response' end record_type,
  case when page_id is distinct from coalesce(r, page_id) then r end refers_to
from p left join g on g.h = p.h and n >= 1000
"""

ORACLE_SQL: dict[str, str] = {"op1_itq_near_dup": OP1, "op5_jaccard_join": OP5, "op8_chat_format": OP8, "op12_source_divergence": OP12, "op13_warc_zstd": OP13}
