"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

NGRAM_JACCARD = r"""
with recursive split_words as (
  select doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
shingles as (
  select distinct doc_id, unnest(case
           when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
           when len(w) > 0 then [array_to_string(w, ' ')]
           else [] end) as s
  from split_words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
  select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y
  where 100 * c >= 90 * (a.n + b.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reached as (
  select doc_id as x, doc_id as y from documents
  union
  select r.x, l.y from reached r join both_ways l on r.y = l.x),
lowest as (select x, min(y) as component_id from reached group by x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from documents d left join sizes using (doc_id) join lowest on x = d.doc_id
"""

SUFFIX_DEDUP = """
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (
  select doc_id, p, md5(substr(h, 2 * p + 1, 200)) as s
  from (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) as p from bytes)),
repeats as (
  select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as k from windows) where k > 1),
islands as (
  select doc_id, p, sum(fresh) over (partition by doc_id order by p) as island
  from (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 100 then 1 else 0 end as fresh from repeats)),
spans as (select doc_id, min(p) as a, max(p) + 100 as b from islands group by doc_id, island),
pieces as (
  select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as begin_kept from spans),
kept as (
  select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as tail,
         string_agg(substr(h, 2 * begin_kept + 1, 2 * (a - begin_kept)), '' order by a) as head
  from pieces join bytes using (doc_id) group by doc_id)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(case when head is null then h else head || substr(h, 2 * tail + 1) end)) as kept_sha256
from bytes left join kept using (doc_id)
"""

TOPK_SEARCH = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, r.vec_id, list_inner_product(q.e, r.e)::bigint as score
  from v q join v r on q.vec_id <> r.vec_id where q.vec_id % 50 = 0),
ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from scored)
select * from ranked where rank <= 5
"""

CONVERSATION_REPAIR = r"""
with crc_table as (
  select list(v order by i) as t from (
    select i, list_reduce([i::bigint] || range(8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from range(256) r(i))),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
  from conversations),
coded as (
  select keyed.*, xor(list_reduce([4294967295::bigint] || list_transform(range(1, len(k) + 1), lambda i: ord(k[i])::bigint),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as damage
  from keyed, crc_table),
hurt as (
  select conv_id, turn, case when damage = 4 then 'user' else role end as role,
         case damage when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
         unnest(case when damage = 3 then [1, 2] else [1] end) as copy
  from coded where damage <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as n from hurt),
judged as (
  select *, left(role, 1) as i, lag(role) over (partition by conv_id order by n) as before,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') as filled,
         row_number() over (partition by conv_id, role, text order by n) > 1 as again
  from placed),
faulty as (
  select *, case when filled = '' then 'blank' when again then 'duplicate'
                 when right(filled, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from judged),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (n > 1 and left(before, 1) || i not in ('su', 'ua', 'au')) as illegal,
         list({'i': i, 'gone': fault in ('blank', 'duplicate'), 'stays': case when fault = 'truncated' then 5 else 0 end} order by n) as rows
  from faulty group by conv_id),
steps as (
  select conv_id, list_reduce(
    flatten(list_transform(rows, lambda r: [{'ins': true, 'r': r}, {'ins': false, 'r': r}])) || [{'ins': true, 'r': rows[1]}],
    lambda a, x: case when x.ins then {
        's0': a.s0, 's1': a.s1,
        's2': list_min([a.s2, {'c': a.s0.c + 5, 'a': a.s0.a || 'I'}, {'c': a.s1.c + 5, 'a': a.s1.a || 'I'}, {'c': a.s3.c + 5, 'a': a.s3.a || 'I'}]),
        's3': list_min([a.s3, {'c': a.s2.c + 5, 'a': a.s2.a || 'I'}, {'c': a.s0.c + 10, 'a': a.s0.a || 'II'}, {'c': a.s1.c + 10, 'a': a.s1.a || 'II'}])
      } else {
        's0': {'c': a.s0.c + 2, 'a': a.s0.a || 'D'},
        's1': list_min([{'c': a.s1.c + 2, 'a': a.s1.a || 'D'},
                        {'c': case when x.r.gone or x.r.i <> 's' then 1000000000000 else a.s0.c + x.r.stays end, 'a': a.s0.a || 'K'}]),
        's2': list_min([{'c': a.s2.c + 2, 'a': a.s2.a || 'D'}] || list_transform([a.s0, a.s1, a.s3], lambda s: {
                        'c': case when x.r.gone then 1000000000000 when x.r.i = 'u' then s.c + x.r.stays else s.c + x.r.stays + 1 end,
                        'a': s.a || case when x.r.i = 'u' then 'K' else 'R' end})),
        's3': list_min([{'c': a.s3.c + 2, 'a': a.s3.a || 'D'}] || list_transform([a.s2], lambda s: {
                        'c': case when x.r.gone then 1000000000000 when x.r.i = 'a' then s.c + x.r.stays else s.c + x.r.stays + 1 end,
                        'a': s.a || case when x.r.i = 'a' then 'K' else 'R' end}))
      } end,
    {'s0': {'c': 0::bigint, 'a': ''}, 's1': {'c': 1000000000000::bigint, 'a': ''},
     's2': {'c': 1000000000000::bigint, 'a': ''}, 's3': {'c': 1000000000000::bigint, 'a': ''}}) as z
  from counted),
chosen as (select conv_id, list_min([z.s0, z.s3]) as best from steps),
edits as (select conv_id, best.a as audit, unnest(range(1, len(best.a) + 1)) as p from chosen),
edited as (
  select e.conv_id, p, audit[p] as e, len(translate(audit[:p], 'I', '')) as n, len(translate(audit[:p], 'D', '')) as place
  from edits e),
stood as (
  select e.conv_id, p, e.e, place, f.role, f.i, f.text
  from edited e left join faulty f on e.conv_id is not distinct from f.conv_id and e.n = f.n and e.e <> 'I'
  where e.e <> 'D'),
opened as (select conv_id, count(*) as opens from stood where place = 1 and e = 'K' and i = 's' group by conv_id),
repaired as (
  select s.conv_id, sha256(string_agg(
           case when e = 'K' then role when (place - coalesce(opens, 0)) % 2 = 1 then 'user' else 'assistant' end
           || ':' || case when e = 'I' then '' else text end, chr(10) order by p)) as h
  from stood s left join opened o on s.conv_id is not distinct from o.conv_id group by s.conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.c, 0)::bigint as cost,
       coalesce(best.a, '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join counted d on c.conv_id is not distinct from d.conv_id
left join chosen b on c.conv_id is not distinct from b.conv_id
left join repaired r on c.conv_id is not distinct from r.conv_id
"""

ORACLE = {
    "op2_ngram_jaccard": NGRAM_JACCARD,
    "op6_suffix_dedup": SUFFIX_DEDUP,
    "op11_topk_search": TOPK_SEARCH,
    "op13_conversation_repair": CONVERSATION_REPAIR,
}
