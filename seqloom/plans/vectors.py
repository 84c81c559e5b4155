"""Queries over vectors, attention profiles, models and graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import graph as G
from ..operators import model as Mo
from ..operators import pooling as Po
from ..operators import ranking as R
from ..operators import stats as S
from ..operators import windows as W
from ..session import checkpoint, table


def _rounded(v, digits: int = 6):
    return F.transform(v, lambda x: F.round(x.cast("double"), digits))


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def f21_l2(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).select("vec_id", _rounded(N.l2_normalised(F.col("embedding"))).alias("v"))


def f19_positions(spark: SparkSession, d: str) -> DataFrame:
    """The position channel of each entry, over its whole length."""
    x = table(spark, d, "pooled_json").select("entry_id", "exported_at", N.positions(F.col("L")).alias("p"))
    return x.select("entry_id", "exported_at", _rounded("p").alias("p"))


def f20_softmax(spark: SparkSession, d: str) -> DataFrame:
    mask = F.transform("embedding", lambda x, i: i % 3 != 0)
    return _emb(spark, d).select("vec_id", _rounded(N.masked_softmax(F.col("embedding"), mask), 8).alias("w"))


def f23_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Weights of each vector as 0 to 100."""
    lo, hi = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double")
    return _emb(spark, d).select("vec_id", F.transform("embedding", lambda x: F.round(N.scaled(x.cast("double"), lo, hi, 0.5), 4)).alias("b"))


def f24_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).select("vec_id", F.round(N.entropy(N.softmax(F.col("embedding"))), 6).alias("entropy"))


def f26_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel's size and sum; null where it is missing."""
    v = F.try_element_at(F.try_element_at("pools", F.lit("backbone")), F.lit("full_mean"))
    return table(spark, d, "pooled_json").select("entry_id", "exported_at", F.size(v).cast("bigint").alias("n"), F.round(N.total(F.filter(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))), 4).alias("total")).filter("n >= 0")


def f34_soft_mask(spark: SparkSession, d: str) -> DataFrame:
    m = N.soft_mask(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.3), F.lit(0.6), 0.1)
    return _emb(spark, d).select("vec_id", _rounded(m).alias("m"))


def pred9_finite(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_element_at(F.try_element_at("pools", F.lit("backbone")), F.lit("span_attn_norm"))
    x = table(spark, d, "pooled_json").select("entry_id", "exported_at", v.alias("v"))
    return x.filter(N.all_finite(F.col("v")) & (F.size("v") == 64)).select("entry_id", "exported_at")


def pred8_pooled_filter(spark: SparkSession, d: str) -> DataFrame:
    """The flagged best entry of each base, with P of at least 0.5 and a panel."""
    x = R.flag_best(table(spark, d, "pooled_json").filter("base_id is not null"), ["base_id"], [R.not_nan(F.col("P")).desc(), F.asc("entry_id"), F.asc("exported_at")])
    v = F.try_element_at(F.try_element_at("pools", F.lit("backbone")), F.lit("span_attn_norm"))
    return x.filter(F.col("is_best") & (F.col("P") >= 0.5) & v.isNotNull()).select("entry_id", "base_id")


def a5_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return Po.pool_rows(_emb(spark, d), ["label"], "embedding").select("label", _rounded("pooled").alias("v"))


def a6_weighted_pool(spark: SparkSession, d: str) -> DataFrame:
    x = Po.pool_rows(_emb(spark, d), ["label"], "embedding", F.pmod(F.col("vec_id"), F.lit(7)), "attn-norm")
    return x.select("label", _rounded("pooled").alias("v"))


def a7_panels(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as eight tokens of eight numbers, pooled in six ways."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    w = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.abs(F.get(F.col("embedding"), i * 8)).cast("double"))
    x = _emb(spark, d).select("vec_id", Po.panels(tokens, w, F.lit(2), F.lit(5), 3).alias("p"))
    names = ["full_mean", "full_attn_norm", "span_mean", "span_attn_norm", "topk_attn_norm", "nonspan_mean"]
    return x.select("vec_id", *(F.transform(f"p.{n}", lambda v: F.round(v.cast("double"), 5) + F.lit(0.0)).alias(n) for n in names))  # no -0.0


def a8_residue_vectors(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    w = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get(F.col("embedding"), i * 8).cast("double"))
    x = _emb(spark, d).select("vec_id", Po.residue_vectors(tokens, w, F.lit(100), F.lit(2), F.lit(5), "span").alias("r"))
    return x.select("vec_id", "r.scope", F.col("r.local_pos").cast("array<bigint>").alias("local_pos"), F.col("r.abs_pos").cast("array<bigint>").alias("abs_pos"), _rounded("r.w").alias("w"))


def a4_attention_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of overlapping windows of each label's vectors, added up."""
    x = _emb(spark, d).select("label", (F.pmod(F.col("vec_id"), F.lit(5)) * 16).cast("int").alias("start"), "embedding", F.lit(128).alias("n"))
    return Po.aggregate_attention(x, "label", "start", "embedding", "n").select("label", _rounded("profile", 4).alias("profile"))


def a10_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    x = _emb(spark, d).select(F.pmod("vec_id", F.lit(50)).alias("k"), "vec_id", "embedding", F.col("embedding")[0].cast("double").alias("P"))
    return R.deduplicate_vectors(x, "k", "embedding", "P", F.asc("vec_id"), "mean").select("k", "vec_id", _rounded("embedding").alias("v"))


def w8_hpd(spark: SparkSession, d: str) -> DataFrame:
    """The shortest span with 60 % of the attention."""
    x = _emb(spark, d).select("vec_id", N.softmax(F.transform("embedding", lambda x: x.cast("double") * 10)).alias("w"))
    return Mo.hpd_spans(x, "vec_id", "w", 0.6).select("vec_id", F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"), F.round("mass", 6).alias("mass"), F.round("entropy", 6).alias("entropy"))


def w11_span(spark: SparkSession, d: str) -> DataFrame:
    """Mean and width of each vector's attention, and the span of two sigma."""
    w = N.softmax(F.transform("embedding", lambda x: x.cast("double") * 10))
    at = lambda i: i / 63.0

    def moments(w):
        spread = lambda mu: F.sqrt(N.total(F.transform(w, lambda v, i: v * (at(i) - mu) ** 2)) + 1e-8)
        return N.bound(N.total(F.transform(w, lambda v, i: v * at(i))), lambda mu: F.struct(mu.alias("mu"), F.least(F.lit(0.5), F.greatest(spread(mu), F.lit(0.02))).alias("sd")))

    x = _emb(spark, d).select("vec_id", N.bound(w, moments).alias("m")).select("vec_id", "m.mu", "m.sd")
    return x.select("vec_id", F.round("mu", 6).alias("mu"), F.round("sd", 6).alias("sd"), F.round(F.greatest(F.lit(0.0), F.col("mu") - 2 * F.col("sd")), 6).alias("s"), F.round(F.least(F.lit(1.0), F.col("mu") + 2 * F.col("sd")), 6).alias("e"))


def w10_peaks(spark: SparkSession, d: str) -> DataFrame:
    return W.find_peaks(_emb(spark, d), "vec_id", "embedding", 0.1, 3)


def w16_top_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Positions of the tenth of largest weights within the span 8 to 55."""
    x = _emb(spark, d).select("vec_id", F.posexplode("embedding").alias("pos", "w")).filter("pos between 8 and 55")
    return Po.ranked_within(x, ["vec_id"], "w", "pos", 5).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.col("pos").cast("bigint"))).alias("positions"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).filter("vec_id % 20 = 0")


def j16_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Of every twentieth vector the five most similar of all."""
    x = G.nearest(_emb(spark, d), "vec_id", "embedding", _queries(spark, d), 5)
    return x.select("query", F.col("key").alias("vec_id"), "similarity")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's five most similar of all, so that both directions exist."""
    x = _emb(spark, d)
    return checkpoint(G.nearest(x, "vec_id", "embedding", x, 5))


def g1_undirected(spark: SparkSession, d: str) -> DataFrame:
    return G.undirected(_edges(spark, d), "query", "key", "similarity").withColumn("weight", F.round("weight", 6))


def g2_mutual(spark: SparkSession, d: str) -> DataFrame:
    return G.mutual(_edges(spark, d), "query", "key", "similarity").withColumn("weight", F.round("weight", 6))


def g3_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return G.adjacency(G.undirected(_edges(spark, d), "query", "key", "similarity"))


def g4_components(spark: SparkSession, d: str) -> DataFrame:
    x = G.principal_components(_emb(spark, d), "vec_id", "embedding", 0.5)
    return x.select("vec_id", F.size("v").cast("bigint").alias("axes"), F.round(N.norm(F.col("v")), 6).alias("norm"))


def g5_communities(spark: SparkSession, d: str) -> DataFrame:
    return G.communities(G.undirected(_edges(spark, d), "query", "key", "similarity"))


def g6_consensus(spark: SparkSession, d: str) -> DataFrame:
    return G.bootstrap_consensus(G.undirected(_edges(spark, d), "query", "key", "similarity"), 10, 0.8, 0.5)


def g8_consensus_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the consensus edges without weights, and the support of each node."""
    c = checkpoint(g6_consensus(spark, d))
    labels = G.communities(c.select("src", "dst", F.col("freq").alias("weight")), weighted=False)
    return G.labelled_support(labels, c, 3)


def a39_cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    x = S.cluster_quality(_emb(spark, d), "embedding", "label")
    return x.select("n", "clusters", F.round("davies_bouldin", 5).alias("davies_bouldin"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


def u3_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the sequences scored with fixed random weights, the best of each record."""
    x = W.chunked(table(spark, d, "fasta_records").select("rec_id", T.sanitised(F.col("seq")).alias("seq")), "seq", 300, 48)
    x = x.withColumn("key", T.chunk_id(F.col("rec_id").cast("string"), F.col("chunk_index"), F.col("chunks_total"), F.col("aa_start"), F.col("aa_end")))
    p = Mo.score_chunks(x, "key", "chunk", Mo.hash_embedder(4), Mo.Weights.random(4, 1, (16, 12, 8)))
    best = R.best_by(p.withColumn("base_id", T.base_id(F.col("key"))), ["base_id"], F.struct(R.not_nan(F.col("P")), F.col("key")), ["key", "P", "S_idx", "E_idx"])
    return best.select("base_id", "key", F.round("P", 6).alias("P"), "S_idx", "E_idx")


QUERIES = {
    f.__name__: f
    for f in (
        f21_l2, f19_positions, f20_softmax, f23_scaled, f24_entropy, f26_panel, f34_soft_mask, pred8_pooled_filter, pred9_finite, a4_attention_profile, a5_mean_pool, a6_weighted_pool, a7_panels, a8_residue_vectors, a10_deduplicated,
        w8_hpd, w10_peaks, w11_span, w16_top_fraction, j16_nearest, g1_undirected, g2_mutual, g3_adjacency, g4_components, g5_communities, g6_consensus, g8_consensus_clusters, a39_cluster_quality, u3_predictions,
    )
}

_D = "select vec_id, label, embedding::double[] as v from embeddings"
_SM = f"""
e as (select vec_id, list_transform(embedding, lambda x: x::double * 10) as v from embeddings),
r as (select vec_id, list_transform(v, lambda x: exp(x - list_max(v))) as r from e), w as (select vec_id, list_transform(r, lambda x: x / list_sum(r)) as w from r)
"""
_TOK = """
t as (select vec_id, i, unnest(range(1, 9)) as j, e from (select vec_id, unnest(range(0, 8)) as i, embedding as e from embeddings)),
x as (select vec_id, i, j, e[i * 8 + j]::double as x, abs(e[i * 8 + 1])::double as w from t)
"""
_Q = """
q as (select vec_id, embedding::double[] as v, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings {0}),
p as (select a.vec_id as query, b.vec_id as key, round(greatest(0.0, list_dot_product(a.v, b.v) / (a.n * b.n)), 6) as s from q a join {1} b on a.vec_id <> b.vec_id),
k as (select * from p qualify row_number() over (partition by query order by s desc, key) <= 5)
"""
_QQ = _Q.format("", "q")
SQL = {
    "f21_l2": f"with d as ({_D}), n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from d) select vec_id, list_transform(v, lambda x: round(case when n <= 1e-8 then x else x / n end, 6)) as v from n",
    "f19_positions": "select entry_id, exported_at, case when L < 1 then [] else list_transform(range(0, L), lambda i: round(case when L <= 1 then 0.0 else i / (L - 1) end, 6)) end as p from pooled_json",
    "f20_softmax": """
with x as (select vec_id, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings), m as (select *, max(case when i % 3 <> 0 then x end) over (partition by vec_id) as t from x),
r as (select *, case when i % 3 <> 0 then exp(x - t) else 0.0 end as r from m), s as (select *, sum(r) over (partition by vec_id) as s from r)
select vec_id, list(round(r / s, 8) order by i) as w from s group by vec_id""",
    "f23_scaled": f"with d as ({_D}) select vec_id, list_transform(v, lambda x: round(case when list_max(v) <= list_min(v) then 50.0 else 100 * pow((x - list_min(v)) / (list_max(v) - list_min(v)), 0.5) end, 4)) as b from d",
    "f24_entropy": """
with x as (select vec_id, unnest(embedding)::double as x from embeddings), m as (select *, max(x) over (partition by vec_id) as t from x), s as (select *, exp(x - t) / sum(exp(x - t)) over (partition by vec_id) as w from m)
select vec_id, round(-sum(greatest(w, 1e-12) * ln(greatest(w, 1e-12))) / ln(64), 6) as entropy from s group by vec_id""",
    "f26_panel": "with x as (select entry_id, exported_at, pools['backbone']['full_mean'] as v from pooled_json) select entry_id, exported_at, len(v)::bigint as n, round(coalesce(list_sum(list_transform(list_filter(v, lambda x: isfinite(x)), lambda x: x::double)), 0.0), 4) as total from x where v is not null",
    "f34_soft_mask": """
with x as (select vec_id, unnest(range(0, 64)) as i, unnest(embedding)::double as w from embeddings), a as (select *, greatest(0.3 - i / 63, i / 63 - 0.6) as a from x)
select vec_id, list(round(case when w = 0 then 0.0 when a <= 0 then 1.0 when a < 0.1 then 0.5 * (1 + cos(pi() * a / 0.1)) else 0.0 end, 6) order by i) as m from a group by vec_id""",
    "pred8_pooled_filter": """
with x as (select *, row_number() over (partition by base_id order by coalesce(case when isnan(P) then '-inf'::double else P end, '-inf'::double) desc, entry_id, exported_at) = 1 as best from pooled_json where base_id is not null)
select entry_id, base_id from x where best and P >= 0.5 and pools['backbone']['span_attn_norm'] is not null""",
    "pred9_finite": "with x as (select entry_id, exported_at, pools['backbone']['span_attn_norm'] as v from pooled_json) select entry_id, exported_at from x where len(v) = 64 and len(list_filter(v, lambda e: e is not null and isfinite(e))) = 64",
    "a4_attention_profile": """
with x as (select label, (vec_id % 5) * 16 + unnest(range(0, 64)) as pos, unnest(embedding)::double as w from embeddings), s as (select label, pos, sum(w) as w from x group by 1, 2),
f as (select label, unnest(range(0, 128)) as pos from (select distinct label from embeddings))
select label, list(round(coalesce(w, 0.0), 4) order by pos) as profile from f left join s using (label, pos) group by label""",
    "a5_mean_pool": "with x as (select label, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings), m as (select label, i, avg(x) as x from x group by 1, 2) select label, list(round(x, 6) order by i) as v from m group by 1",
    "a6_weighted_pool": """
with x as (select label, vec_id % 7 as w, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings), m as (select label, i, case when sum(w) > 0 then sum(w * x) / sum(w) else avg(x) end as x from x group by 1, 2)
select label, list(round(x, 6) order by i) as v from m group by 1""",
    "a7_panels": f"""with {_TOK}, k as (select distinct vec_id, i, w from x), r as (select vec_id, i, row_number() over (partition by vec_id order by w desc, i) as n from k),
y as (select x.*, r.n from x join r using (vec_id, i)),
o as (select vec_id, j, list(x order by i) as xs, list(w order by i) as ws, list(w * x order by i) as wx, list(w order by n) filter (where n <= 3) as wt, list(w * x order by n) filter (where n <= 3) as xt from y group by 1, 2),
m as (select vec_id, j, list_sum(xs) / 8 as a, case when list_sum(ws) > 1e-12 then list_sum(wx) / list_sum(ws) else list_sum(xs) / 8 end as b, list_sum(xs[3:6]) / 4 as c,
  list_sum(wx[3:6]) / list_sum(ws[3:6]) as d, list_sum(xt) / list_sum(wt) as e, list_sum(list_concat(xs[1:2], xs[7:8])) / 4 as f from o)
select vec_id, list(round(a, 5) + 0.0 order by j) as full_mean, list(round(b, 5) + 0.0 order by j) as full_attn_norm, list(round(c, 5) + 0.0 order by j) as span_mean, list(round(d, 5) + 0.0 order by j) as span_attn_norm,
  list(round(e, 5) + 0.0 order by j) as topk_attn_norm, list(round(f, 5) + 0.0 order by j) as nonspan_mean from m group by 1""",
    "a8_residue_vectors": "select vec_id, 'span' as scope, [2, 3, 4, 5]::bigint[] as local_pos, [102, 103, 104, 105]::bigint[] as abs_pos, list_transform([17, 25, 33, 41], lambda i: round(embedding[i]::double, 6)) as w from embeddings",
    "a10_deduplicated": """
with b as (select vec_id % 50 as k, vec_id from embeddings qualify row_number() over (partition by vec_id % 50 order by embedding[1] desc, vec_id) = 1),
x as (select vec_id % 50 as k, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings), m as (select k, i, avg(x) as x from x group by 1, 2)
select k, vec_id, list(round(x, 6) order by i) as v from m join b using (k) group by 1, 2""",
    "w8_hpd": f"""with {_SM}, c as (select vec_id, unnest(range(0, 64)) as i, unnest(w) as w from w), s as (select *, sum(w) over (partition by vec_id order by i) as c from c),
p as (select a.vec_id, a.i as s, b.i as e, b.c - a.c + a.w as mass from s a join s b on a.vec_id = b.vec_id and b.i >= a.i and b.c - a.c + a.w >= 0.6 - 1e-12),
f as (select * from p qualify row_number() over (partition by vec_id order by e - s, s) = 1), h as (select vec_id, -sum(greatest(w, 1e-12) * ln(greatest(w, 1e-12))) / ln(64) as h from c group by 1)
select vec_id, s, e, round(mass, 6) as mass, round(h, 6) as entropy from f join h using (vec_id)""",
    "w11_span": f"""with {_SM}, c as (select vec_id, unnest(range(0, 64)) / 63.0 as p, unnest(w) as w from w), m as (select vec_id, sum(w * p) as mu, sum(w * p * p) as q from c group by 1),
v as (select c.vec_id, mu, least(0.5, greatest(0.02, sqrt(sum(w * (p - mu) * (p - mu)) + 1e-8))) as sd from c join m using (vec_id) group by 1, 2)
select vec_id, round(mu, 6) as mu, round(sd, 6) as sd, round(greatest(0.0, mu - 2 * sd), 6) as s, round(least(1.0, mu + 2 * sd), 6) as e from v""",
    "w16_top_fraction": """
with x as (select vec_id, unnest(range(0, 64)) as pos, unnest(embedding) as w from embeddings), r as (select * from x where pos between 8 and 55 qualify row_number() over (partition by vec_id order by w desc, pos) <= 5)
select vec_id, list(pos::bigint order by pos) as positions from r group by 1""",
    "j16_nearest": "with " + _Q.format("", "q").replace("from q a join", "from (select * from q where vec_id % 20 = 0) a join") + " select query, key as vec_id, s as similarity from k",
    "g1_undirected": f"with {_QQ} select least(query, key) as src, greatest(query, key) as dst, round(max(s), 6) as weight from k group by 1, 2",
    "g2_mutual": f"with {_QQ} select least(query, key) as src, greatest(query, key) as dst, round(avg(s), 6) as weight from k group by 1, 2 having count(*) = 2",
    "g3_adjacency": f"with {_QQ}, u as (select query as node, key as o from k union select key, query from k) select node, list(o order by o) as neighbours from u group by 1",
    "a39_cluster_quality": """
with x as (select label, vec_id, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings), c as (select label, i, avg(x) as m, count(*) as n from x group by 1, 2), g as (select i, avg(x) as g from x group by 1),
d as (select x.label, vec_id, sum((x - m) * (x - m)) as d from x join c on x.label = c.label and x.i = c.i group by 1, 2), s as (select label, avg(sqrt(d)) as s, sum(d) as w, count(*) as n from d group by 1),
f as (select a.label as a, b.label as b, sqrt(sum((a.m - b.m) * (a.m - b.m))) as f from c a join c b on a.i = b.i and a.label <> b.label group by 1, 2),
db as (select avg(r) as db from (select a, max((sa.s + sb.s) / f) as r from f join s sa on sa.label = a join s sb on sb.label = b group by a)),
bt as (select sum(n * (m - g) * (m - g)) as b from c join g using (i)), t as (select count(*) as k, sum(n) as n, sum(w) as w from s)
select n::bigint as n, k as clusters, round(db, 5) as davies_bouldin, round((b / (k - 1)) / (w / (n - k)), 4) as calinski_harabasz from t, bt, db""",
}
