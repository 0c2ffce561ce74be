"""DuckDB SQL for the operators that SQL can express, written from their contracts."""

OP1 = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all("text", '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 12))::bigint as point
  from documents
), per as (
  select source, sum(size)::bigint as source_size, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint]::double as weight
  from sized group by source
), ordered as (
  select *, row_number() over (order by 2.0 * source_size / weight, source nulls last) as k, 2.0::double * source_size as cap from per
), level as (
  select o.k, (1.5::double * (select sum(source_size) from per) - coalesce((select sum(cap) from ordered p where p.k < o.k), 0))
              / (select sum(weight) from ordered p where p.k >= o.k) as height, weight, cap
  from ordered o
), water as (select min_by(height, k) as height from level where height * weight < cap
), goal as (
  select source, source_size, coalesce(least((select height from water) * weight, cap), cap)::double as target from ordered
), split as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from goal
), run as (
  select s.source, s.point, sum(s.size) as held, sum(sum(s.size)) over (partition by s.source order by s.point) as total
  from sized s group by s.source, s.point
), edge as (
  select r.source, min(r.point) as point, min_by(g.target - g.whole * g.source_size - (r.total - r.held), r.point) as rest, min_by(r.held, r.point) as held
  from run r join split g on r.source is not distinct from g.source
  where r.total > g.target - g.whole * g.source_size group by r.source
)
select d.doc_id, d.size, g.source_size, g.target,
       (d.size * (g.whole + case when d.point < e.point or (d.point = e.point and e.rest * 2 > e.held) then 1 else 0 end))::bigint as taken
from sized d join split g on d.source is not distinct from g.source left join edge e on d.source is not distinct from e.source
"""

OP6 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 50 = 0
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 5
"""

OP11 = """
with drawn as (
  select doc_id, coalesce("text", '') as t, length(coalesce("text", ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
), numbers as (
  select doc_id, t, n, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as b,
         ('0x' || substr(h, 17, 8))::bigint % 100 as p, ('0x' || substr(h, 25, 8))::bigint % 100 as o from drawn
), formed as (
  select doc_id, t, n, least(a, b) as lo, greatest(a, b) as hi,
         case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or p >= 90 then 'plain'
              when o < 20 then 'spm' else 'psm' end as form from numbers
), parts as (
  select *, substr(t, 1, lo) as x, substr(t, lo + 1, hi - lo) as y, substr(t, hi + 1, n - hi) as z from formed
)
select doc_id, n, form, case when form <> 'plain' then lo end as prefix_chars, case when form <> 'plain' then hi - lo end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y
              else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256, sha256(t) as restored_sha256
from parts
"""

OP12 = """
with own as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, "role", "text") as pos,
         {'r': coalesce("role", ''), 't': coalesce("text", '')} as said
  from conversations where conv_id is not null
), plans as (
  select c, c - c % 5 as leader, count(*) as n,
         xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(c::varchar)::bigint + 1),
             lambda i: [ord(substr(c::varchar, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end)) % 9 as h
  from own group by c
), turns as (
  select p.c, o.pos, o.said from plans p join own o on o.c = p.leader and o.pos <= p.h
  union all
  select p.c, p.h + o.pos as pos, o.said from plans p join own o on o.c = p.c and o.pos > p.h
), lists as (
  select p.c, coalesce(list(t.said order by t.pos) filter (t.said is not null), []) as l from plans p left join turns t on t.c = p.c group by p.c
), steps as (
  select c, len(l) as n, d, l[1:d] as path, case when d > 0 then strlen(l[d].t) else 0 end as size
  from lists, unnest(range(0, len(l) + 1)) as u(d)
), nodes as (
  select d, path, min(c) as conv_id, count(*) as n_convs, max(size) as size, max(n) > d as inner_node,
         sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '')) as ends_sha256
  from steps group by d, path
), named as (
  select s.c, s.d, n.conv_id from steps s join nodes n on n.d = s.d and n.path = s.path
), kids as (
  select p.conv_id, p.d, count(distinct k.conv_id) as n_children from named p join named k on k.c = p.c and k.d = p.d + 1 group by all
), pairs as (
  select distinct a.conv_id, a.d, b.conv_id as below, b.d as e from named a join named b on b.c = a.c and b.d >= a.d
), sums as (
  select p.conv_id, p.d, sum(case when n.inner_node then 0 else 1 end)::bigint as n_leaves, sum((n.n_convs - 1) * n.size)::bigint as saved
  from pairs p join nodes n on n.conv_id = p.below and n.d = p.e group by all
), ups as (
  select distinct k.conv_id, k.d, p.conv_id as parent_conv_id from named k join named p on p.c = k.c and p.d = k.d - 1
)
select n.conv_id, n.d::bigint as depth, u.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves, s.saved as saved_tokens, n.ends_sha256
from nodes n join sums s on s.conv_id = n.conv_id and s.d = n.d
left join kids k on k.conv_id = n.conv_id and k.d = n.d left join ups u on u.conv_id = n.conv_id and u.d = n.d
"""

ORACLES = {"op1_mixing": OP1, "op6_topk": OP6, "op11_fill_in_middle": OP11, "op12_prefix_trie": OP12}
