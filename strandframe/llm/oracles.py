"""SQL for the queries that SQL can express on whole tables, by plain definitions instead of the operators' methods."""

SUBSTRINGS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
  w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from d, range(0, greatest(n - 49, 0)) t(i)),
  m as (select s, min(doc_id) as low from w group by s),
  r as (select doc_id, i from w join m using (s) where low < doc_id),
  k as (select doc_id, i, sum(case when i <= p + 50 then 0 else 1 end) over (partition by doc_id order by i) as run from (select *, lag(i) over (partition by doc_id order by i) as p from r)),
  spans as (select doc_id, run, min(i) as a, max(i) + 50 as b from k group by 1, 2),
  pieces as (select s.doc_id, s.run, substr(h, 2 * coalesce(lag(b) over (partition by s.doc_id order by a), 0) + 1, 2 * (a - coalesce(lag(b) over (partition by s.doc_id order by a), 0))) as piece, b, a from spans s join d using (doc_id)),
  kept as (select doc_id, string_agg(piece, '' order by a) as front, max(b) as last, count(*) as n_spans, sum(b - a) as n_removed from pieces group by 1)
select d.doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from d left join kept using (doc_id)
"""

VECTORS = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
  u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
  l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and a.n > 0 and b.n > 0 where list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
  walk(id, c) as (select a, a from l union select l.b, walk.c from walk join l on l.a = walk.id),
  comp as (select id, min(c) as c from walk group by 1), cnt as (select a, count(*) as k from l group by 1)
select vec_id, coalesce(k, 0) as n_links, coalesce(c, vec_id) as component_id, coalesce(c, vec_id) = vec_id as kept
from embeddings left join comp on id = vec_id left join cnt on a = vec_id
"""

LINES = r"""
with l as (select doc_id, unnest(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as i from documents),
  s as (select doc_id, i, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) as w from l),
  g as (select * from s where len(w) > 0),
  c as (select w, min((doc_id, i)) as first, len(w) as n from g group by w),
  k as (select row_number() over (order by first) as id, w, n from c),
  f as (select row_number() over (order by first) as id, first from c),
  t as (select id, n, unnest(w) as token from k),
  j as (select b.id, a.id as earlier, count(*) as common, any_value(a.n) as na, any_value(b.n) as nb from t a join t b on a.token = b.token and a.id < b.id and a.n >= 0.8 * b.n and b.n >= 0.8 * a.n group by 1, 2),
  gone as (select distinct id from j where common >= 0.8 * (na + nb - common) - 1e-9),
  stay as (select first[1] as doc_id, first[2] as i from f where id not in (select id from gone)),
  kept as (select doc_id, string_agg(cast(i as varchar), ',' order by i) as kept, count(*) as k from stay group by 1),
  cnt as (select doc_id, count(*) as n from g group by 1)
select d.doc_id, coalesce(n, 0) as n_lines, coalesce(n, 0) - coalesce(k, 0) as n_removed, coalesce(kept, '') as kept
from documents d left join cnt using (doc_id) left join kept using (doc_id)
"""
