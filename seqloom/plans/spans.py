"""Queries over intervals, spans and evidence, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import evidence as E
from ..operators import intervals as I
from ..operators.coverage import trimmed
from ..operators.ranking import best_by, best_rows
from ..session import table


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Half-open ali and env intervals of hits with both ends."""
    x = table(spark, d, "hmmer_dom_hits").filter("qid is not null and ali_from is not null and ali_to is not null")
    x = x.withColumn("qid", trimmed(F.col("qid"))).withColumn("iv", N.half_open(F.col("ali_from"), F.col("ali_to")))
    return x.select("hit_id", "qid", "qlen", "target_name", "target_acc_base", "i_evalue", F.col("iv.s").alias("s"), F.col("iv.e").alias("e"))


def f11_half_open(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "hmmer_dom_hits").select("hit_id", N.half_open(F.col("ali_from"), F.col("ali_to")).alias("h"), N.one_based(F.col("env_from"), F.col("env_to"), "closed0").alias("o"))
    return x.select("hit_id", F.col("h.s").alias("h_s"), F.col("h.e").alias("h_e"), F.col("o.s").alias("o_s"), F.col("o.e").alias("o_e"))


def f12_span_indexes(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "pooled_json").filter("L > 0").select("entry_id", "exported_at", "orig_start", N.span_indexes(F.col("S_norm"), F.col("E_norm"), F.col("L")).alias("i"))
    return x.select("entry_id", "exported_at", F.col("i.s").alias("s_idx"), F.col("i.e").alias("e_idx"), (F.col("orig_start") + F.col("i.s") + 1).alias("gff_start"), (F.col("orig_start") + F.col("i.e") + 1).alias("gff_end"))


def i1_merge_half_open(spark: SparkSession, d: str) -> DataFrame:
    """Union with gaps of up to 25 positions closed, as older tools did."""
    return I.merge(_hits(spark, d), ["qid"], touch=25)


def i2_merge_closed(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "hmmer_dom_hits").select("target_name", F.least("env_from", "env_to").alias("s"), F.greatest("env_from", "env_to").alias("e"))
    return I.merge(x, ["target_name"], touch=1)


def i3_intersect_length(spark: SparkSession, d: str) -> DataFrame:
    """Positions of a query that hits of both confident and weak e-values cover."""
    h = _hits(spark, d)
    x = I.intersection(h.filter("i_evalue <= 1e-10"), h.filter("i_evalue > 1e-10"), ["qid"])
    return x.groupBy("qid").agg(F.sum(F.col("e") - F.col("s")).alias("n"))


def i4_intersect_closed(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).withColumn("e", F.col("e") - 1)
    return I.intersection(h.filter("i_evalue <= 1e-10"), h.filter("i_evalue > 1e-10"), ["qid"], touch=1, bucket=300)


def i5_set_iou(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).withColumn("e", F.col("e") - 1)
    x = I.set_iou(h.filter("i_evalue <= 1e-10"), h.filter("i_evalue > 1e-10"), ["qid"], h)
    return x.select("qid", F.round("iou", 6).alias("iou"))


def i6_span_iou(spark: SparkSession, d: str) -> DataFrame:
    """Predicted against labelled spans of the same chunk, as fractions of its length; the hull form on indexes."""
    p = best_rows(table(spark, d, "pooled_json").select("entry_id", "chunk_id", "exported_at", "S_norm", "E_norm", "S_idx", "E_idx"), ["chunk_id"], [F.desc("entry_id"), F.desc("exported_at")])
    t = best_rows(table(spark, d, "label_table").filter("use_span and S is not null and E is not null and L > 1").select("row_id", trimmed(F.col("ids")).alias("chunk_id"), "L", F.least("S", "E").alias("s"), F.greatest("S", "E").alias("e")), ["chunk_id"], [F.asc("row_id")])
    x = t.join(p, "chunk_id", "left")
    norm = lambda c: F.col(c) / (F.col("L") - 1)
    iou = N.span_iou(F.coalesce("S_norm", F.lit(0.0)), F.coalesce("E_norm", F.lit(0.0)), norm("s"), norm("e"))
    return x.select("row_id", F.round(iou, 6).alias("iou"), F.round(N.hull_iou(F.col("S_idx"), F.col("E_idx"), F.col("s"), F.col("e")), 6).alias("hull"), F.col("entry_id").isNotNull().alias("predicted"))


def i8_pack_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Lanes of all hits with both ends, in the order of their ids."""
    h = _hits(spark, d).withColumn("e", F.col("e") - 1)
    return I.pack_lanes(h, "qid", order="hit_id")


def a15_union_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Union length over the largest known query length; not clipped."""
    h = _hits(spark, d)
    n = h.groupBy("qid").agg(F.max("qlen").alias("qlen"))
    return I.union_length(h, ["qid"]).join(n, "qid").select("qid", F.col("length").cast("bigint").alias("covered"), F.round(F.col("length") / F.col("qlen"), 6).alias("coverage"))


def a16_model_summary(spark: SparkSession, d: str) -> DataFrame:
    return I.coverage_summary(_hits(spark, d), "qid", "target_name", "qlen")


def a18_best_by_target(spark: SparkSession, d: str) -> DataFrame:
    """The least e-value and coverages of each query and target, with the profile's length."""
    h = _hits(spark, d)
    u = I.union_length(h, ["qid", "target_name"])
    b = h.groupBy("qid", "target_name").agg(F.min("i_evalue").alias("best_e"), F.max("qlen").alias("qlen"))
    p = table(spark, d, "domain_profiles").select("target_name", "model_len")
    x = b.join(u, ["qid", "target_name"]).join(p, "target_name", "left")
    cov = lambda c: F.round(F.least(F.lit(1.0), F.col("length") / F.nullif(F.col(c), F.lit(0))), 6)
    return x.select("qid", "target_name", "best_e", cov("qlen").alias("qcov"), cov("model_len").alias("dcov"))


def a19_length_mode(spark: SparkSession, d: str) -> DataFrame:
    """The commonest length of each query (the smallest of equally common ones) and whether others differ by more than 5 %."""
    h = table(spark, d, "hmmer_dom_hits").filter("qid is not null and qlen is not null").select(trimmed(F.col("qid")).alias("qid"), "qlen")
    n = h.groupBy("qid", "qlen").agg(F.count("*").alias("n"))
    m = n.groupBy("qid").agg(F.max_by("qlen", F.struct("n", -F.col("qlen"))).alias("mode"), F.max("qlen").alias("hi"), F.min("qlen").alias("lo"))
    return m.select("qid", "mode", (F.greatest(F.col("hi") - F.col("mode"), F.col("mode") - F.col("lo")) > 0.05 * F.col("mode")).alias("differs"))


def a20_primary_span(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of hits with gaps up to 25, and of each query the longest, then the one of the least e-value, then the first."""
    h = _hits(spark, d)
    m = I.merge(h, ["qid"], touch=25).withColumnsRenamed({"s": "cs", "e": "ce"})
    w = Window.partitionBy("qid").orderBy("p", "k")
    # every hit goes to the last cluster that begins at or before it: one ordered pass, no pairs
    both = m.select("qid", F.col("cs").alias("p"), F.lit(0).alias("k"), "cs", "ce", F.lit(None).cast("double").alias("ev")).unionByName(h.select("qid", F.col("s").alias("p"), F.lit(1).alias("k"), F.lit(None).cast("int").alias("cs"), F.lit(None).cast("int").alias("ce"), F.col("i_evalue").alias("ev")))
    filled = both.select("qid", "k", "ev", F.last("cs", True).over(w).alias("cs"), F.last("ce", True).over(w).alias("ce")).filter("k = 1")
    c = filled.groupBy("qid", "cs", "ce").agg(F.min("ev").alias("best_e"), F.count("*").alias("hits"))
    rank = F.struct((F.col("ce") - F.col("cs")), -F.col("best_e"), -F.col("cs"))
    return best_by(c, ["qid"], rank, ["cs", "ce", "best_e", "hits"]).withColumnsRenamed({"cs": "s", "ce": "e"})


def pred6_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Hits outside the allow-list of accessions, confident and not empty."""
    allowed = table(spark, d, "domain_profiles").filter("model_len >= 200").select("target_acc_base").distinct()
    return _hits(spark, d).filter("i_evalue <= 1e-5 and s < e").join(allowed, "target_acc_base", "left_anti").select("hit_id", "qid", "target_acc_base")


def a13_ranked_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One hit a query: least e-value, then the longest description-bearing one, nulls worst, then the first."""
    h = table(spark, d, "hmmer_dom_hits").filter("qid is not null").select(trimmed(F.col("qid")).alias("qid"), "hit_id", "i_evalue", (F.abs(F.col("ali_to") - F.col("ali_from")) + 1).alias("len"), F.col("description").isNotNull().cast("int").alias("told"))
    return best_rows(h, ["qid"], [F.asc_nulls_last("i_evalue"), F.desc_nulls_last("len"), F.desc("told"), F.asc("hit_id")]).select("qid", "hit_id")


def j1_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence with its hits' coverage, its best hit and its scores, and a class by ordered rules."""
    seqs = table(spark, d, "fasta_records").filter("seq_id is not null").select(trimmed(F.col("seq_id")).alias("qid"), F.length("seq").alias("n")).groupBy("qid").agg(F.max("n").cast("bigint").alias("length"))
    h = _hits(spark, d)
    palm = h.filter(F.col("target_name").startswith("Palm"))
    best = palm.groupBy("qid").agg(F.min("i_evalue").alias("palm_e"), F.min_by(F.struct("s", "e"), F.struct("i_evalue", "hit_id")).alias("span"))
    rest = h.filter(~F.col("target_name").startswith("Palm") & (F.col("i_evalue") <= 1e-5) & (F.col("s") < F.col("e")))
    covered = I.union_length(rest, ["qid"]).withColumnRenamed("length", "covered")
    spans = best.select("qid", F.col("span.s").alias("s"), F.col("span.e").alias("e"))
    overlap = E.overlap_with_span(rest, spans, "qid")
    score = table(spark, d, "fold_scores").filter((F.col("metric") == "score") & (F.abs("value") < float("inf"))).groupBy(trimmed(F.col("seq_id")).alias("qid")).agg(F.max("value").alias("score"))
    x = seqs
    for side in (best, covered, overlap, score):
        x = x.join(side, "qid", "left")
    positive, strong = F.col("palm_e") <= 1e-5, F.coalesce(F.col("score") >= 75, F.lit(False))
    clash = E.conflict(F.col("overlap"), F.col("span.e") - F.col("span.s"), 20, 0.25)
    full = F.coalesce(F.col("covered") / F.nullif(F.col("length"), F.lit(0)) >= 0.8, F.lit(False))
    code = E.first_match(
        [
            (positive & strong & ~clash, "P_CONSENSUS"),
            (full & ~F.coalesce(positive, F.lit(False)) & ~strong, "N_OTHER_DOMAINS_DOMINANT"),
            (positive & strong & clash, "U_SPAN_CONFLICT"),
            (full & positive, "U_FULL_BUT_POSITIVE"),
            (positive, "U_HIT_ONLY"),
            (strong, "U_SCORE_ONLY"),
        ],
        "U_NO_SIGNAL",
    )
    n = E.normalised_span(F.col("span.s"), F.col("span.e"), F.col("length"))
    x = x.withColumn("code", code).withColumn("sp", n)
    p = F.col("code").startswith("P_")
    return x.select("qid", "code", F.coalesce("covered", F.lit(0)).cast("bigint").alias("covered"), F.coalesce("overlap", F.lit(0)).alias("overlap"), F.when(p, F.round("sp.S", 6)).alias("S"), F.when(p, F.round("sp.E", 6)).alias("E"), F.when(p, F.round("sp.sigma", 6)).alias("sigma"), F.when(p, F.round(N.evidence_confidence(F.col("palm_e"), F.col("covered") / F.col("length"), F.lit(None).cast("double"), F.col("sp.truncated")), 6)).alias("conf"))


def j1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Queries of hits that no sequence has, counted."""
    seqs = table(spark, d, "fasta_records").filter("seq_id is not null").select(trimmed(F.col("seq_id")).alias("qid")).distinct()
    h = table(spark, d, "hmmer_dom_hits").filter("qid is not null").select(trimmed(F.col("qid")).alias("qid"))
    return h.join(seqs, "qid", "left_anti").agg(F.count("*").alias("hits"), F.countDistinct("qid").alias("queries"))


def i9_chosen_span(spark: SparkSession, d: str) -> DataFrame:
    """The ali interval where it is usable, else the env interval."""
    x = table(spark, d, "hmmer_dom_hits").select("hit_id", E.chosen_span(F.col("ali_from"), F.col("ali_to"), F.col("env_from"), F.col("env_to")).alias("c"))
    return x.select("hit_id", "c.source", "c.lo", "c.hi", "c.reason")


QUERIES = {
    f.__name__: f
    for f in (
        f11_half_open, f12_span_indexes, i1_merge_half_open, i2_merge_closed, i3_intersect_length, i4_intersect_closed, i5_set_iou, i6_span_iou, i8_pack_lanes, i9_chosen_span, a15_union_coverage, a16_model_summary, a18_best_by_target,
        a19_length_mode, a20_primary_span, a13_ranked_dedupe, pred6_conflicts, j1_evidence, j1_unmatched,
    )
}

_BL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_H = f"""h as (select hit_id, trim(qid, {_BL}) as qid, qlen, target_name, target_acc_base, i_evalue, greatest(0, least(ali_from, ali_to) - 1) as s, greatest(0, ali_from, ali_to) as e
  from hmmer_dom_hits where qid is not null and ali_from is not null and ali_to is not null)"""


def _merge(name: str, source: str, keys: str, touch: int) -> str:
    """CTE name(keys, s, e) of merged intervals."""
    return f"""
{name}_a as (select *, max(e) over (partition by {keys} order by s, e rows between unbounded preceding and 1 preceding) as m from {source} where s <= e),
{name}_b as (select *, sum(case when m is null or s > m + {touch} then 1 else 0 end) over (partition by {keys} order by s, e rows unbounded preceding) as r from {name}_a),
{name} as (select {keys}, min(s) as s, max(e) as e from {name}_b group by {keys}, r)"""


_STRONG_WEAK = "a as (select * from h where i_evalue <= 1e-10), b as (select * from h where i_evalue > 1e-10)"
_CLOSED = "h as (select * exclude (e), e - 1 as e from h0)"
_H0 = _H.replace("h as (", "h0 as (", 1)


def _cut(touch: int) -> str:
    return f"c as (select ma.qid, greatest(ma.s, mb.s) as s, least(ma.e, mb.e) as e from ma join mb on ma.qid = mb.qid and ma.s < mb.e + {touch} and mb.s < ma.e + {touch})"


_LEN = f"select trim(seq_id, {_BL}) as qid, max(length(seq))::bigint as length from fasta_records where seq_id is not null group by 1"
SQL = {
    "f11_half_open": """
select hit_id, case when ali_from is not null and ali_to is not null then greatest(0, least(ali_from, ali_to) - 1) end as h_s, case when ali_from is not null and ali_to is not null then greatest(0, ali_from, ali_to) end as h_e,
  case when env_from is not null and env_to is not null then least(env_from, env_to) + 1 end as o_s, case when env_from is not null and env_to is not null then greatest(env_from, env_to) + 1 end as o_e from hmmer_dom_hits""",
    "f12_span_indexes": """
with i as (select entry_id, exported_at, orig_start, greatest(0, least(L - 1, round_even(S_norm * (L - 1), 0)::int)) as a, greatest(0, least(L - 1, round_even(E_norm * (L - 1), 0)::int)) as b from pooled_json where L > 0)
select entry_id, exported_at, least(a, b) as s_idx, greatest(a, b) as e_idx, orig_start + least(a, b) + 1 as gff_start, orig_start + greatest(a, b) + 1 as gff_end from i""",
    "i1_merge_half_open": f"with {_H}, {_merge('m', 'h', 'qid', 25)} select * from m",
    "i2_merge_closed": f"with h as (select target_name, least(env_from, env_to) as s, greatest(env_from, env_to) as e from hmmer_dom_hits), {_merge('m', 'h', 'target_name', 1)} select * from m",
    "i3_intersect_length": f"with {_H}, {_STRONG_WEAK}, {_merge('ma', 'a', 'qid', 0)}, {_merge('mb', 'b', 'qid', 0)}, {_cut(0)} select qid, sum(e - s)::bigint as n from c group by qid",
    "i4_intersect_closed": f"with {_H0}, {_CLOSED}, {_STRONG_WEAK}, {_merge('ma', 'a', 'qid', 1)}, {_merge('mb', 'b', 'qid', 1)}, {_cut(1)}, {_merge('m', 'c', 'qid', 1)} select qid, s, e from m",
    "i5_set_iou": f"""with {_H0}, {_CLOSED}, {_STRONG_WEAK}, {_merge('ma', 'a', 'qid', 1)}, {_merge('mb', 'b', 'qid', 1)}, {_cut(1)},
la as (select qid, sum(e - s + 1) as n from ma group by qid), lb as (select qid, sum(e - s + 1) as n from mb group by qid), li as (select qid, sum(e - s + 1) as n from c group by qid),
u as (select distinct qid from h)
select u.qid, round(case when coalesce(la.n, 0) + coalesce(lb.n, 0) - coalesce(li.n, 0) = 0 then 1.0 else coalesce(li.n, 0) / (coalesce(la.n, 0) + coalesce(lb.n, 0) - coalesce(li.n, 0)) end, 6) as iou
from u left join la using (qid) left join lb using (qid) left join li using (qid)""",
    "i6_span_iou": f"""
with p as (select * from pooled_json qualify row_number() over (partition by chunk_id order by entry_id desc, exported_at desc) = 1),
t as (select row_id, trim(ids, {_BL}) as chunk_id, L, least(S, E) as s0, greatest(S, E) as e0 from label_table where use_span and S is not null and E is not null and L > 1
  qualify row_number() over (partition by trim(ids, {_BL}) order by row_id) = 1),
x as (select row_id, entry_id, coalesce(S_norm, 0.0) as s1, coalesce(E_norm, 0.0) as e1, s0 / (L_t - 1) as s2, e0 / (L_t - 1) as e2, S_idx, E_idx, s0, e0
  from (select t.row_id, t.L as L_t, t.s0, t.e0, p.entry_id, p.S_norm, p.E_norm, p.S_idx, p.E_idx from t left join p on t.chunk_id = p.chunk_id)),
y as (select *, greatest(0.0, least(e1, e2) - greatest(s1, s2)) as i from x)
select row_id, round(case when (e1 - s1) + (e2 - s2) - i <= 0 then 0.0 else i / ((e1 - s1) + (e2 - s2) - i) end, 6) as iou,
  round(case when S_idx is null or E_idx is null then null else greatest(0, least(E_idx, e0) - greatest(S_idx, s0) + 1) / (greatest(E_idx, e0) - least(S_idx, s0) + 1) end, 6) as hull, entry_id is not null as predicted from y""",
    "i9_chosen_span": """
with x as (select hit_id, ali_from as a, ali_to as b, env_from as c, env_to as d, ali_to - ali_from + 1 as n, env_to - env_from + 1 as m,
  case when ali_to < ali_from then 'pp_wrapped:' || ali_from || '>' || ali_to else 'pp_missing' end as why from hmmer_dom_hits)
select hit_id, case when b >= a then case when n between 30 and 400 then 'pp' else '' end when d >= c and m between 30 and 600 then 'ext' else '' end as source,
  case when b >= a then case when n between 30 and 400 then a end when d >= c and m between 30 and 600 then c end as lo,
  case when b >= a then case when n between 30 and 400 then b end when d >= c and m between 30 and 600 then d end as hi,
  case when b >= a then case when n between 30 and 400 then 'valid_pp' else 'pp_len_out_of_range:' || n end when d >= c then case when m between 30 and 600 then 'fallback_ext_after_' || why else 'ext_len_out_of_range:' || m end else why end as reason
from x""",
    "a15_union_coverage": f"with {_H}, {_merge('m', 'h', 'qid', 0)}, n as (select qid, max(qlen) as qlen from h group by qid) select m.qid, sum(e - s)::bigint as covered, round(sum(e - s) / max(qlen), 6) as coverage from m join n using (qid) group by m.qid",
    "a16_model_summary": f"""with {_H}, {_merge('m', 'h', 'qid, target_name', 0)}, n as (select qid, max(qlen) as qlen from h group by qid),
c as (select qid, target_name, round(sum(e - s) / max(qlen), 4) as c from m join n using (qid) where qlen > 0 group by qid, target_name),
t as (select * from c qualify row_number() over (partition by qid order by c desc, target_name) <= 8)
select qid, string_agg(target_name || ':' || printf('%.4f', c), ',' order by c desc, target_name) as summary from t group by qid""",
    "a18_best_by_target": f"""with {_H}, {_merge('m', 'h', 'qid, target_name', 0)}, u as (select qid, target_name, sum(e - s) as n from m group by qid, target_name),
b as (select qid, target_name, min(i_evalue) as best_e, max(qlen) as qlen from h group by qid, target_name)
select qid, target_name, best_e, case when nullif(qlen, 0) is null then 1.0 else round(least(1.0, n / nullif(qlen, 0)), 6) end as qcov, case when nullif(model_len, 0) is null then 1.0 else round(least(1.0, n / nullif(model_len, 0)), 6) end as dcov
from b join u using (qid, target_name) left join domain_profiles using (target_name)""",
    "a19_length_mode": f"""
with n as (select trim(qid, {_BL}) as qid, qlen, count(*) as n from hmmer_dom_hits where qid is not null and qlen is not null group by 1, 2),
m as (select qid, first(qlen order by n desc, qlen) as mode, max(qlen) as hi, min(qlen) as lo from n group by qid)
select qid, mode, greatest(hi - mode, mode - lo) > 0.05 * mode as differs from m""",
    "a20_primary_span": f"""with {_H}, {_merge('m', 'h', 'qid', 25)},
c as (select m.qid, m.s, m.e, min(h.i_evalue) as best_e, count(*) as hits from m join h on h.qid = m.qid and h.s >= m.s and h.e <= m.e group by m.qid, m.s, m.e)
select qid, s, e, best_e, hits from c qualify row_number() over (partition by qid order by e - s desc, best_e, s) = 1""",
    "a13_ranked_dedupe": f"""
select trim(qid, {_BL}) as qid, hit_id from hmmer_dom_hits where qid is not null
qualify row_number() over (partition by trim(qid, {_BL}) order by i_evalue asc nulls last, abs(ali_to - ali_from) + 1 desc nulls last, (description is not null)::int desc, hit_id) = 1""",
    "pred6_conflicts": f"with {_H} select hit_id, qid, target_acc_base from h where i_evalue <= 1e-5 and s < e and target_acc_base not in (select target_acc_base from domain_profiles where model_len >= 200)",
    "j1_unmatched": f"select count(*) as hits, count(distinct trim(qid, {_BL})) as queries from hmmer_dom_hits where qid is not null and trim(qid, {_BL}) not in (select trim(seq_id, {_BL}) from fasta_records where seq_id is not null)",
    "j1_evidence": f"""with {_H}, l as ({_LEN}),
b as (select qid, min(i_evalue) as palm_e, first(s order by i_evalue, hit_id) as s, first(e order by i_evalue, hit_id) as e from h where starts_with(target_name, 'Palm') group by qid),
r as (select * from h where not starts_with(target_name, 'Palm') and i_evalue <= 1e-5 and s < e), {_merge('m', 'r', 'qid', 0)},
c as (select qid, sum(e - s) as covered from m group by qid),
o as (select m.qid, sum(least(m.e, b.e) - greatest(m.s, b.s))::bigint as overlap from m join b on m.qid = b.qid and m.s < b.e and b.s < m.e group by m.qid),
v as (select trim(seq_id, {_BL}) as qid, max(value) as score from fold_scores where metric = 'score' and isfinite(value) and seq_id is not null group by 1),
x as (select l.qid, length, palm_e, s, e, coalesce(covered, 0) as covered, coalesce(overlap, 0) as overlap, coalesce(palm_e <= 1e-5, false) as pos, coalesce(score >= 75, false) as strong,
  coalesce(covered / nullif(length, 0) >= 0.8, false) as ful, coalesce(overlap, 0) >= 20 and coalesce(overlap, 0) >= 0.25 * (e - s) as clash
  from l left join b using (qid) left join c using (qid) left join o using (qid) left join v using (qid)),
y as (select *, case when pos and strong and not clash then 'P_CONSENSUS' when ful and not pos and not strong then 'N_OTHER_DOMAINS_DOMINANT' when pos and strong and clash then 'U_SPAN_CONFLICT'
  when ful and pos then 'U_FULL_BUT_POSITIVE' when pos then 'U_HIT_ONLY' when strong then 'U_SCORE_ONLY' else 'U_NO_SIGNAL' end as code,
  greatest(0, least(s, length)) as a, greatest(0, least(e, length)) as z, greatest(70.0 / greatest(1.0, length), 0.02) as least_w from x)
select qid, code, covered::bigint as covered, overlap, case when starts_with(code, 'P_') and z > a then round(a / length, 6) end as S, case when starts_with(code, 'P_') and z > a then round(z / length, 6) end as E,
  case when starts_with(code, 'P_') and z > a then round(greatest((z - a) / length / 4.0, least_w / 2), 6) end as sigma,
  case when starts_with(code, 'P_') then round((0.6 * greatest(0.0, least(1.0, (-log10(case when palm_e <= 0 then 1e-300 else palm_e end) - 3.0) / 27.0)) + 0.3 * greatest(0.0, least(1.0, coalesce(nullif(covered, 0) / length, 0) / 0.60)))
    * case when z > a and (a = 0 or z = length) then 0.5 else 1.0 end, 6) end as conf from y""",
}
