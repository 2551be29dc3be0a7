"""DuckDB SQL for the rows of the queries that SQL can express."""

OP5 = """
with d as (select doc_id, coalesce(text, '') as body from documents),
g as (select body, max(doc_id) as keep_id, count(*) as group_size from d group by body)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.body) as text_sha256
from d join g on d.body = g.body
"""

OP6 = r"""
with d as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || ' ' || coalesce(text, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
           / case when q.mark > 0 then 2.0 when q.mark <= 0 then 0.5 else 1.0 end as key
  from documents left join (select doc_id as of_id, max(quality) as mark from labels group by 1) q on doc_id = of_id),
t as (select source, sum(size)::bigint as source_size from d group by 1),
w as (select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source nulls last) - 1) % 3)::int + 1] as weight,
             source_size * 2.0::double as cap from t),
l as (select *, (sum(source_size) over ())::double * 1.5::double as budget,
             coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double) as cap_before,
             sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as weight_left from w),
r as (select *, (budget - cap_before) / weight_left as rate from l),
f as (select *, max(case when rate * weight <= cap then rate end) over () as first_open from r),
g as (select source, source_size, case when first_open is null then cap else least(cap, first_open * weight) end as target from f),
p as (select d.doc_id, d.size, g.source_size, g.target,
             case when g.source_size > 0 then least(floor(g.target / g.source_size)::bigint, 2) else 0 end as epochs,
             (sum(d.size) over (partition by d.source order by d.key, d.doc_id nulls first, d.size rows between unbounded preceding and current row))::bigint as upto
      from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (epochs * size + case when epochs < 2 then greatest(0, least(size, floor(target - epochs * source_size)::bigint - upto + size)) else 0 end)::bigint as taken
from p
"""

OP7 = r"""
with own(conv_id, turn, role, text) as (
  values (-7::bigint, 0::bigint, 'user', '\### Assistant: </turn> ok'), (-7::bigint, 1::bigint, 'assistant', '\### Assistant: </turn> ok')),
c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select * from own)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24)::bigint as formatted_chars
from c group by conv_id
"""

OP9 = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
e as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (select *, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as key from e),
c as (select key, max(doc_id) as holder from k where length(key) >= 20 group by key having count(distinct r) >= 3),
m as (select k.*, c.key is not null and k.doc_id is distinct from c.holder as gone from k left join c on k.key = c.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by r
"""

ORACLES = {"op5_exact_dedup": OP5, "op6_mixing": OP6, "op7_chat": OP7, "op9_line_dedup": OP9}
