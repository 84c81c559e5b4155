"""Queries of ranking, curves, thresholds, statistics and windows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import stats as S
from ..operators import windows as W
from ..operators.coverage import trimmed
from ..session import checkpoint, table


def _r(x, digits: int = 6):
    return F.round(x, digits)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pooled_json").filter("base_id is not null")


_ORDER = lambda: [R.not_nan(F.col("P")).desc(), F.asc("entry_id"), F.asc("exported_at")]


def a1_best_chunk(spark: SparkSession, d: str) -> DataFrame:
    return R.best_rows(_entries(spark, d), ["base_id"], _ORDER()).select("base_id", "entry_id", "chunk_id", "P")


def a2_flagged(spark: SparkSession, d: str) -> DataFrame:
    return R.flag_best(_entries(spark, d).select("base_id", "entry_id", "exported_at", "P"), ["base_id"], _ORDER())


def a3_flagged_first(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a span first, then the largest P."""
    x = _entries(spark, d).withColumn("flag", F.coalesce(F.col("pool_meta.span_len") > 50, F.lit(False)))
    return R.best_rows(x, ["base_id"], [F.desc("flag"), *_ORDER()]).select("base_id", "entry_id", "flag")


def pred2_min_p(spark: SparkSession, d: str) -> DataFrame:
    """The best chunk is found first and filtered then."""
    return a1_best_chunk(spark, d).filter("P >= 0.5").select("base_id", "P")


def f13_calibrated(spark: SparkSession, d: str) -> DataFrame:
    z = N.calibrated(F.col("logit"), F.col("temperature"))
    return table(spark, d, "pooled_json").select("entry_id", "exported_at", _r(z).alias("z"), _r(N.sigmoid(z)).alias("p"))


def f14_evalue_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hmmer_dom_hits").select("hit_id", _r(N.evalue_score(F.col("i_evalue"))).alias("score"))


def w5_top_targets(spark: SparkSession, d: str) -> DataFrame:
    """The five best queries of each target."""
    h = table(spark, d, "hmmer_dom_hits").filter("qid is not null").groupBy("target_name", trimmed(F.col("qid")).alias("qid")).agg(F.min("i_evalue").alias("e"))
    return R.top_n(h, ["target_name"], [F.asc("e"), F.asc("qid")], 5).select("target_name", "qid", "e", F.col("rank").cast("bigint").alias("rank"))


def w6_average_ranks(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", "user_id", "value")
    return R.average_ranks(x, ["user_id"], "value")


def w7_mid_percentile(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", "event_type", "value")
    return R.mid_percentile(x, ["event_type"], "value").withColumn("pct", _r("pct")).drop("value")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Entries with a label, of each chunk the one with the largest P."""
    p = R.best_rows(table(spark, d, "pooled_json").select("entry_id", "chunk_id", "P", "logit", "exported_at"), ["chunk_id"], [*_ORDER()])
    t = R.best_rows(table(spark, d, "label_table").filter("labels is not null").select("row_id", trimmed(F.col("ids")).alias("chunk_id"), "labels"), ["chunk_id"], [F.asc("row_id")])
    return t.join(p, "chunk_id").select("row_id", "chunk_id", "labels", F.round("P", 2).alias("P"), "logit")


def a21_average_precision(spark: SparkSession, d: str) -> DataFrame:
    c = M.score_counts(_labelled(spark, d), [], "P", F.col("labels") == 2)
    return M.average_precision(c, []).select(_r("ap").alias("ap"))


def a22_curves(spark: SparkSession, d: str) -> DataFrame:
    c = M.score_counts(_labelled(spark, d), [], "P", F.col("labels") == 2)
    return M.curves(c, []).select("score", *(_r(n).alias(n) for n in ("recall", "precision", "fpr")))


def a22_row_curves(spark: SparkSession, d: str) -> DataFrame:
    return M.row_curves(_labelled(spark, d), [], "P", F.col("labels") == 2, "row_id").select("n", *(_r(c).alias(c) for c in ("recall", "precision", "fpr")))


def a23_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    """Positives against the rest, and against label 0 alone."""
    x = _labelled(spark, d)
    both = x.withColumn("scope", F.lit("rest")).unionByName(x.filter("labels <> 1").withColumn("scope", F.lit("clean")))
    return M.roc_auc(M.score_counts(both, ["scope"], "P", F.col("labels") == 2), ["scope"]).select("scope", _r("auc").alias("auc"))


def a24_recall_at_precision(spark: SparkSession, d: str) -> DataFrame:
    return M.recall_at_precision(M.score_counts(_labelled(spark, d), [], "P", F.col("labels") == 2), [], 0.5).select(_r("recall").alias("recall"))


def a25_class_counts(spark: SparkSession, d: str) -> DataFrame:
    x = _labelled(spark, d)
    return x.agg(F.count("*").alias("n"), *(F.count_if(F.col("labels") == i).alias(f"n_{i}") for i in range(3)), _r(F.avg((F.col("P") >= 0.5).cast("double"))).alias("called"))


def a44_temperature(spark: SparkSession, d: str) -> DataFrame:
    t = M.calibrate_temperature(_labelled(spark, d).filter("labels <> 1"), "logit", F.col("labels") == 2)
    return spark.createDataFrame([(round(t, 4),)], "temperature double")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """The best finite value and the fold of each source and id."""
    v = F.col("value")
    x = table(spark, d, "fold_scores").filter("fold is not null and seq_id is not null").withColumn("seq_id", trimmed(F.col("seq_id")))
    ok = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), F.when(F.col("metric") == "evalue", F.greatest(v, F.lit(1e-300))).otherwise(v))
    best = F.when(F.first("metric") == "evalue", F.min(ok)).otherwise(F.max(ok))
    return x.groupBy("source", "seq_id").agg(F.first("metric").alias("metric"), F.min("fold").alias("fold"), best.alias("value"))


def a12_best_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("source", "seq_id", "value", F.col("fold").cast("bigint").alias("fold"))


def _curve(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    s = checkpoint(_scores(spark, d))
    sizes = s.groupBy(*keys).agg(F.count("*").alias("n"))
    return M.threshold_fpr(s, sizes, keys, "value", F.col("metric") == "evalue")


def a26_threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d, ["source", "fold"]).select("source", F.col("fold").cast("bigint").alias("fold"), "threshold", F.col("passed").cast("bigint").alias("passed"), _r("fpr").alias("fpr"))


def a28_operating_points(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([(0.001,), (0.01,), (0.1,)], "target double")
    c = _curve(spark, d, ["source", "metric"]).withColumnRenamed("source", "src")
    x = M.operating_points(c, ["src", "metric"], targets, F.col("metric") == "evalue")
    return x.select("src", "target", F.when(F.col("source") == "data", F.col("threshold")).alias("threshold"), _r("fpr").alias("fpr"), "source")


def a29_held_out(spark: SparkSession, d: str) -> DataFrame:
    """The rate in each fold at the threshold that the other folds give for a target of 0.05."""
    s = checkpoint(_scores(spark, d))
    # One row a fold and source; each row of a source meets the folds of its source.
    x = s.join(s.select("source", F.col("fold").alias("held")).distinct(), "source")
    train = x.filter("held <> fold")
    sizes = train.groupBy("source", "metric", "held").agg(F.count("*").alias("n"))
    low = F.col("metric") == "evalue"
    c = M.threshold_fpr(train, sizes, ["source", "metric", "held"], "value", low).filter("fpr <= 0.05")
    k = F.when(low, F.col("threshold")).otherwise(-F.col("threshold"))
    t = c.groupBy("source", "held").agg(F.max_by("threshold", k).alias("t"))
    test = x.filter("held = fold").join(t, ["source", "held"], "left")
    hit = F.coalesce(F.when(low, F.col("value") <= F.col("t")).otherwise(F.col("value") >= F.col("t")), F.lit(False))
    return test.groupBy("source", "held").agg(F.count("*").alias("n"), F.count_if(hit).alias("passed"), F.max("t").alias("t")).withColumn("held", F.col("held").cast("bigint"))


def j7_unscored(spark: SparkSession, d: str) -> DataFrame:
    """Scored ids that no sequence has, by source."""
    s = table(spark, d, "fold_scores").filter("seq_id is not null").select("source", trimmed(F.col("seq_id")).alias("seq_id"))
    f = table(spark, d, "fasta_records").filter("seq_id is not null").select(trimmed(F.col("seq_id")).alias("seq_id")).distinct()
    return s.join(f, "seq_id", "left_anti").groupBy("source").agg(F.countDistinct("seq_id").alias("ids"))


def a30_dose_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "fold_scores").withColumn("value", F.when(F.abs("value") < float("inf"), F.col("value")).otherwise(F.lit(float("nan"))))
    y = S.dose_summary(x.filter("metric = 'score'"), ["source", "fold"], "value", F.col("value") >= 50)
    return y.select("source", F.col("fold").cast("bigint").alias("fold"), "n", *(_r(c).alias(c) for c in ("mean", "sd", "sem", "positive")))


def a32_overview(spark: SparkSession, d: str) -> DataFrame:
    """Means of the folds' means, unweighted."""
    x = table(spark, d, "fold_scores").filter("metric = 'score' and fold is not null and abs(value) < double('inf') and not isnan(value)")
    y = S.dose_summary(x, ["source", "fold"], "value", F.col("value") >= 50)
    return y.groupBy("source").agg(_r(F.avg("mean")).alias("mean"), _r(F.avg("positive")).alias("positive"))


def a34_size_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    y = S.size_summary(x, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return y.select("l_returnflag", "l_linestatus", "n", *(_r(c, 4).alias(c) for c in ("mean", "sd", "cv", "least", "median", "most")))


def a35_time_bins(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_type", (F.col("value") / 7).alias("t"), "value")
    return S.time_bins(x, ["event_type"], "t", "value", 0.5).select("event_type", "bin", _r("mean").alias("mean"))


def a36_linear_fit(spark: SparkSession, d: str) -> DataFrame:
    x = S.linear_fit(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return x.select("l_returnflag", _r("slope", 4).alias("slope"), _r("intercept", 4).alias("intercept"), _r("r2").alias("r2"))


def a36_saturation(spark: SparkSession, d: str) -> DataFrame:
    """Which saturation model fits summed price by quantity."""
    x = table(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.avg("l_extendedprice").alias("y"))
    return S.saturation_fits(x, "l_returnflag", "l_quantity", "y").select("l_returnflag", "model", _r("r2", 4).alias("r2"), "best")


def a37_correlations(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    p = S.pearson(x, ["l_returnflag"], "l_quantity", "l_extendedprice")
    s = S.spearman(x, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return p.join(s, "l_returnflag").select("l_returnflag", _r("r").alias("r"), _r("rho").alias("rho"))


def a38_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_type", (F.col("value") - 50).alias("diff"))
    return S.wilcoxon(x, ["event_type"], "diff").select("event_type", "n", _r("w", 1).alias("w"), _r("z").alias("z"))


def a40_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Problems of the chunk manifest, counted."""
    x = table(spark, d, "chunk_manifest").withColumn("p", T.parsed_chunk(F.col("chunk_id")))
    tags = [
        (F.col("orig_id").isNull(), "no_orig_id"),
        (F.col("aa_end").isNull(), "no_end"),
        (F.col("orig_aa_len").isNull(), "no_length"),
        (F.col("aa_end") <= F.col("aa_start"), "empty_span"),
        (F.col("aa_end") > F.col("orig_aa_len"), "beyond_length"),
        (F.col("chunk_aa_len") != F.col("aa_end") - F.col("aa_start"), "length_differs"),
        (F.col("chunk_index") > F.col("chunks_total"), "index_beyond_total"),
        (F.col("p.index") != F.col("chunk_index"), "id_differs"),
    ]
    found = F.filter(F.array(*(F.when(c, t) for c, t in tags)), lambda t: t.isNotNull())
    return x.select(F.explode(found).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def a42_best_epoch(spark: SparkSession, d: str) -> DataFrame:
    """The first row with the largest rate, and with the smallest, of each source's earlier runs."""
    x = table(spark, d, "split_results").filter("heldout_fpr is not null")
    up, down = F.struct(F.col("heldout_fpr"), F.col("heldout_fold")), F.struct(-F.col("heldout_fpr"), F.col("heldout_fold"))
    return x.groupBy("source").agg(F.max_by("heldout_fold", up).alias("worst"), F.max_by("heldout_fold", down).alias("best"))


def a46_pivot(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "label_table").filter("labels is not null").groupBy(F.coalesce("use_span", F.lit(False)).alias("use_span")).pivot("labels", [0, 1, 2]).agg(F.count(F.lit(1)))
    return x.select("use_span", *(F.coalesce(F.col(str(i)), F.lit(0)).alias(f"n_{i}") for i in range(3)))


def a47_cell_edges(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "split_results").select("source", "target_fpr")
    return W.cell_edges(x, ["source"], "target_fpr").select("source", "target_fpr", _r("low").alias("low"), _r("high").alias("high"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value")


def w1_running(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _events(spark, d).select("event_id", _r(F.sum("value").over(w), 4).alias("run"), F.max("value").over(w).alias("top"))


def w3_rolling_max(spark: SparkSession, d: str) -> DataFrame:
    return W.rolling(_events(spark, d), ["user_id"], ["ts", "event_id"], "value", 2, "max", "top").select("event_id", "top")


def w4_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return W.rolling(_events(spark, d), ["user_id"], ["ts", "event_id"], "value", 2, "mean_edges", "m").select("event_id", _r("m").alias("m"))


def f22_gaussian(spark: SparkSession, d: str) -> DataFrame:
    return W.smoothed(_events(spark, d), ["user_id"], ["ts", "event_id"], "value", [0.25, 0.5, 0.25], "m").select("event_id", _r("m").alias("m"))


def w9_standardised(spark: SparkSession, d: str) -> DataFrame:
    x = W.standardised(_events(spark, d), ["user_id"], "value", "z")
    y = W.robust_standardised(x, ["user_id"], "value", "rz", 1.0)
    return y.select("event_id", _r("z").alias("z"), _r("rz").alias("rz"))


def w18_rates(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("c"))
    return W.rates(x, ["user_id"], "t", "c", scale=1e6).select("event_id", _r("rate").alias("rate"))


def w19_totals(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.to_date("l_shipdate").alias("day"), "l_quantity").groupBy("l_suppkey", "l_partkey", "day").agg(F.max("l_quantity").alias("q"))
    return W.monotone_totals(x, "l_suppkey", "l_partkey", "day", "q").select("l_suppkey", "day", _r("total", 2).alias("total"), _r("peak", 2).alias("peak"))


def j14_nearest(spark: SparkSession, d: str) -> DataFrame:
    """For each hit the nearest start of an entry's span on the same base, ties to the smaller: two ordered looks, no pairs.

    Positions of a base are looked up once each, so that the rows of a base are no more than its length.
    """
    h = table(spark, d, "hmmer_dom_hits").filter("qid is not null and ali_from is not null").select(trimmed(F.col("qid")).alias("k"), F.col("ali_from").cast("bigint").alias("p"), "hit_id")
    e = table(spark, d, "pooled_json").filter("base_id is not null").select(F.col("base_id").alias("k"), (F.col("orig_start") + F.col("S_idx")).cast("bigint").alias("p")).distinct()
    u = h.select("k", "p", F.lit(None).cast("bigint").alias("q")).distinct().unionByName(e.select("k", "p", F.col("p").alias("q"))).groupBy("k", "p").agg(F.max("q").alias("q"))
    up, down = (Window.partitionBy("k").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("p"), F.desc("p")))
    x = u.select("k", "p", F.last("q", True).over(up).alias("a"), F.last("q", True).over(down).alias("b"))
    left = F.col("b").isNull() | (F.col("p") - F.col("a") <= F.col("b") - F.col("p"))
    x = x.select("k", "p", F.when(left & F.col("a").isNotNull(), F.col("a")).otherwise(F.col("b")).alias("nearest")).filter("nearest is not null")
    return h.join(x, ["k", "p"]).select("hit_id", "nearest")


def f25_json_field(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


def j2_semi(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    inside = n.join(r.filter("r_regionkey < 3"), n.n_regionkey == r.r_regionkey, "left_semi")
    return s.join(inside, s.s_nationkey == inside.n_nationkey, "left_semi").select("s_suppkey")


def j9_listed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in the order of a list: the panel's accessions, with the documents about each."""
    p = table(spark, d, "reference_panel").select(F.col("acc").alias("base_id"), "aa_len", "reviewed")
    n = table(spark, d, "documents").filter("base_id is not null").groupBy("base_id").agg(F.count("*").alias("docs"))
    return p.join(n, "base_id", "left").select("base_id", "reviewed", F.coalesce("docs", F.lit(0)).alias("docs"))


QUERIES = {
    f.__name__: f
    for f in (
        a1_best_chunk, a2_flagged, a3_flagged_first, pred2_min_p, f13_calibrated, f14_evalue_score, w5_top_targets, w6_average_ranks, w7_mid_percentile, a21_average_precision, a22_curves, a22_row_curves, a23_roc_auc,
        a24_recall_at_precision, a25_class_counts, a44_temperature, a12_best_score, a26_threshold_curve, a28_operating_points, a29_held_out, j7_unscored, a30_dose_summary, a32_overview, a34_size_summary, a35_time_bins, a36_linear_fit,
        a36_saturation, a37_correlations, a38_wilcoxon, a40_integrity, a42_best_epoch, a46_pivot, a47_cell_edges, w1_running, w3_rolling_max, w4_smoothed, f22_gaussian, w9_standardised, w18_rates, w19_totals, j14_nearest, f25_json_field,
        j2_semi, j9_listed,
    )
}

_BL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BEST = "row_number() over (partition by base_id order by coalesce(case when isnan(P) then '-inf'::double else P end, '-inf'::double) desc, entry_id, exported_at)"
_LAB = f"""
p as (select entry_id, chunk_id, P, logit from pooled_json qualify row_number() over (partition by chunk_id order by coalesce(case when isnan(P) then '-inf'::double else P end, '-inf'::double) desc, entry_id, exported_at) = 1),
t as (select row_id, trim(ids, {_BL}) as chunk_id, labels from label_table where labels is not null qualify row_number() over (partition by trim(ids, {_BL}) order by row_id) = 1),
x as (select row_id, labels, round(P, 2) as P from t join p using (chunk_id) where P is not null and not isnan(P)),
c as (select P as score, count(*) filter (where labels = 2) as tp, count(*) as n from x group by P),
s as (select *, sum(tp) over w as tps, sum(n) over w as ns, sum(tp) over () as pos, sum(n) over () as total from c window w as (order by score desc))
"""
_SC = f"""
s as (select source, trim(seq_id, {_BL}) as seq_id, first(metric) as metric, min(fold) as fold,
  case when first(metric) = 'evalue' then min(greatest(value, 1e-300)) filter (where isfinite(value)) else max(value) filter (where isfinite(value)) end as value
  from fold_scores where fold is not null and seq_id is not null group by 1, 2)
"""


def _fpr(keys: str) -> str:
    return f"""
n as (select {keys}, count(*) as n from s group by {keys}),
c as (select {keys}, metric, value as threshold, count(*) as c from s where value is not null group by {keys}, metric, value),
f as (select {keys}, metric, threshold, sum(c) over (partition by {keys} order by case when metric = 'evalue' then threshold else -threshold end) as passed from c),
g as (select f.*, passed / n.n as fpr from f join n using ({keys}))"""


SQL = {
    "a1_best_chunk": f"select base_id, entry_id, chunk_id, P from pooled_json where base_id is not null qualify {_BEST} = 1",
    "a2_flagged": f"select base_id, entry_id, exported_at, P, {_BEST} = 1 as is_best from pooled_json where base_id is not null",
    "a3_flagged_first": "with x as (select *, coalesce(pool_meta.span_len > 50, false) as flag from pooled_json where base_id is not null) select base_id, entry_id, flag from x qualify " + _BEST.replace("order by", "order by flag desc,") + " = 1",
    "pred2_min_p": f"select base_id, P from (select * from pooled_json where base_id is not null qualify {_BEST} = 1) where P >= 0.5",
    "f13_calibrated": "select entry_id, exported_at, round(logit / nullif(temperature, 0), 6) as z, round(1 / (1 + exp(-logit / nullif(temperature, 0))), 6) as p from pooled_json",
    "f14_evalue_score": "select hit_id, round(case when i_evalue is null then 0.0 else -log10(case when i_evalue <= 0 then 1e-300 else i_evalue end) end, 6) as score from hmmer_dom_hits",
    "w5_top_targets": f"""
with h as (select target_name, trim(qid, {_BL}) as qid, min(i_evalue) as e from hmmer_dom_hits where qid is not null group by 1, 2)
select *, row_number() over (partition by target_name order by e nulls first, qid)::bigint as rank from h qualify rank <= 5""",
    "w6_average_ranks": "select event_id, user_id, value, rank() over (partition by user_id order by value) + (count(*) over (partition by user_id, value) - 1) / 2.0 as rank from events",
    "w7_mid_percentile": "select event_id, event_type, round((rank() over (partition by event_type order by value) - 1 + 0.5 * count(*) over (partition by event_type, value)) / count(*) over (partition by event_type), 6) as pct from events",
    "a21_average_precision": f"with {_LAB} select round(sum(case when pos > 0 then (tps / ns) * (tp / pos) else 0 end), 6) as ap from s",
    "a22_curves": f"with {_LAB} select score, round(tps / nullif(pos, 0), 6) as recall, round(tps / ns, 6) as precision, round((ns - tps) / nullif(total - pos, 0), 6) as fpr from s",
    "a22_row_curves": f"""with {_LAB}, r as (select row_number() over w as n, sum((labels = 2)::int) over w as tps, sum((labels = 2)::int) over () as pos, count(*) over () as total from x window w as (order by P desc, row_id rows unbounded preceding))
select n, round(tps / nullif(pos, 0), 6) as recall, round(tps / n, 6) as precision, round((n - tps) / nullif(total - pos, 0), 6) as fpr from r""",
    "a23_roc_auc": f"""with {_LAB}, y as (select 'rest' as scope, labels, P from x union all select 'clean', labels, P from x where labels <> 1)
select a.scope, round(sum(case when a.P > b.P then 1.0 when a.P = b.P then 0.5 else 0.0 end) / count(*), 6) as auc from y a join y b on a.scope = b.scope where a.labels = 2 and b.labels <> 2 group by a.scope""",
    "a24_recall_at_precision": f"with {_LAB} select round(coalesce(max(case when tps / ns >= 0.5 and pos > 0 then tps / pos end), 0.0), 6) as recall from s",
    "a25_class_counts": f"""with {_LAB}, z as (select labels, round(P, 2) as P from t join p using (chunk_id))
select count(*) as n, count(*) filter (where labels = 0) as n_0, count(*) filter (where labels = 1) as n_1, count(*) filter (where labels = 2) as n_2, round(avg((P >= 0.5)::int), 6) as called from z""",
    "a12_best_score": f"with {_SC} select source, seq_id, value, fold::bigint as fold from s",
    "a26_threshold_curve": f"with {_SC}, {_fpr('source, fold')} select source, fold::bigint as fold, threshold, passed::bigint as passed, round(fpr, 6) as fpr from g",
    "a28_operating_points": f"""with {_SC}, {_fpr('source')}, t as (select * from (values (0.001::double), (0.01::double), (0.1::double)) v(target)),
k as (select source as src, target, max(passed) filter (where fpr <= target) as p from g, t group by source, target)
select k.src, k.target, g.threshold, round(coalesce(g.fpr, 0.0), 6) as fpr, case when g.threshold is null then 'boundary' else 'data' end as source from k left join g on g.source = k.src and g.passed = k.p""",
    "a29_held_out": f"""with {_SC}, h as (select distinct source, fold as held from s), x as (select s.*, held from s join h using (source)),
n as (select source, held, count(*) as n from x where held <> fold group by source, held),
c as (select source, held, metric, value as threshold, count(*) as c from x where held <> fold and value is not null group by source, held, metric, value),
f as (select source, held, metric, threshold, sum(c) over (partition by source, held order by case when metric = 'evalue' then threshold else -threshold end) as passed from c),
t as (select source, held, arg_max(threshold, passed) as t from f join n using (source, held) where passed / n.n <= 0.05 group by source, held)
select source, held::bigint as held, count(*) as n, count(*) filter (where case when metric = 'evalue' then value <= t else value >= t end) as passed, max(t) as t
from x left join t using (source, held) where held = fold group by source, held""",
    "j7_unscored": f"select source, count(distinct trim(seq_id, {_BL})) as ids from fold_scores where seq_id is not null and trim(seq_id, {_BL}) not in (select trim(seq_id, {_BL}) from fasta_records where seq_id is not null) group by source",
    "a30_dose_summary": """
with x as (select source, fold, case when isfinite(value) then value end as v from fold_scores where metric = 'score' and fold is not null)
select source, fold::bigint as fold, count(*) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round(case when count(v) > 1 then stddev_samp(v) / sqrt(count(v)) end, 6) as sem,
  round(avg((v >= 50)::int), 6) as positive from x group by source, fold""",
    "a32_overview": "with x as (select source, fold, avg(value) as m, avg((value >= 50)::int) as p from fold_scores where metric = 'score' and fold is not null and isfinite(value) group by source, fold) select source, round(avg(m), 6) as mean, round(avg(p), 6) as positive from x group by source",
    "a34_size_summary": """
select l_returnflag, l_linestatus, count(*) as n, round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as sd, round(100 * stddev_samp(l_extendedprice) / nullif(avg(l_extendedprice), 0), 4) as cv,
  round(min(l_extendedprice), 4) as least, round(median(l_extendedprice), 4) as median, round(max(l_extendedprice), 4) as most from lineitem group by all""",
    "a35_time_bins": "select event_type, round_even(value / 7 / 0.5, 0) * 0.5 as bin, round(avg(value), 6) as mean from events group by 1, 2",
    "a36_linear_fit": "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1",
    "a37_correlations": """
with r as (select l_returnflag, l_quantity, l_extendedprice, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as a,
  rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0 as b from lineitem)
select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as r, round(corr(a, b), 6) as rho from r group by 1""",
    "a38_wilcoxon": """
with x as (select event_type, value - 50 as d from events where value <> 50), r as (select *, rank() over (partition by event_type order by abs(d)) + (count(*) over (partition by event_type, abs(d)) - 1) / 2.0 as k from x),
w as (select event_type, count(*) as n, sum(case when d > 0 then k else 0 end) as w from r group by 1)
select event_type, n, round(w, 1) as w, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) as z from w""",
    "a40_integrity": """
with x as (select *, try_cast(regexp_extract(chunk_id, '^(.*?)[|_]chunk_(\\d+)_of_(\\d+)', 2) as int) as pi from chunk_manifest),
t as (select unnest([case when orig_id is null then 'no_orig_id' end, case when aa_end is null then 'no_end' end, case when orig_aa_len is null then 'no_length' end, case when aa_end <= aa_start then 'empty_span' end,
  case when aa_end > orig_aa_len then 'beyond_length' end, case when chunk_aa_len <> aa_end - aa_start then 'length_differs' end, case when chunk_index > chunks_total then 'index_beyond_total' end, case when pi <> chunk_index then 'id_differs' end]) as tag from x)
select tag, count(*) as n from t where tag is not null group by tag""",
    "a42_best_epoch": "select source, first(heldout_fold order by heldout_fpr desc, heldout_fold desc) as worst, first(heldout_fold order by heldout_fpr, heldout_fold desc) as best from split_results where heldout_fpr is not null group by source",
    "a46_pivot": "select coalesce(use_span, false) as use_span, count(*) filter (where labels = 0) as n_0, count(*) filter (where labels = 1) as n_1, count(*) filter (where labels = 2) as n_2 from label_table where labels is not null group by 1",
    "a47_cell_edges": """
with x as (select distinct source, target_fpr as c from split_results), y as (select *, lag(c) over w as a, lead(c) over w as b from x window w as (partition by source order by c))
select source, c as target_fpr, round(coalesce((a + c) / 2, c - (b - c) / 2, c - 0.5), 6) as low, round(coalesce((b + c) / 2, c + (c - a) / 2, c + 0.5), 6) as high from y""",
    "w1_running": "select event_id, round(sum(value) over w, 4) as run, max(value) over w as top from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)",
    "w3_rolling_max": "select event_id, max(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following) as top from events",
    "w4_smoothed": """
with x as (select event_id, sum(value) over (w rows between 2 preceding and 2 following) as s, row_number() over w as i, count(*) over (partition by user_id) as n,
  first_value(value) over (w rows between unbounded preceding and unbounded following) as f, last_value(value) over (w rows between unbounded preceding and unbounded following) as l from events window w as (partition by user_id order by ts, event_id))
select event_id, round((s + greatest(0, 3 - i) * f + greatest(0, i + 2 - n) * l) / 5, 6) as m from x""",
    "f22_gaussian": "select event_id, round(0.25 * coalesce(lead(value) over w, 0) + 0.5 * value + 0.25 * coalesce(lag(value) over w, 0), 6) as m from events window w as (partition by user_id order by ts, event_id)",
    "w9_standardised": """
with m as (select user_id, avg(value) as a, var_pop(value) as v, median(value) as h from events group by 1), x as (select e.*, a, v, h from events e join m using (user_id)), q as (select user_id, median(abs(value - h)) as q from x group by 1)
select event_id, round((value - a) / sqrt(v + 1e-6), 6) as z, round((value - h) / greatest(1.4826 * q, 1.0), 6) as rz from x join q using (user_id)""",
    "w18_rates": """
with x as (select event_id, epoch_us(ts)::double as t, value as c, lag(epoch_us(ts)::double) over w as t0, lag(value) over w as c0 from events window w as (partition by user_id order by ts))
select event_id, round(case when t - t0 > 0 then greatest(0.0, 1e6 * (c - c0) / (t - t0)) end, 6) as rate from x""",
    "w19_totals": """
with x as (select l_suppkey, l_partkey, l_shipdate::date as day, max(l_quantity) as q from lineitem group by 1, 2, 3), y as (select *, max(q) over (partition by l_suppkey, l_partkey order by day) as b from x),
z as (select l_suppkey, day, sum(b - coalesce(b0, 0)) as d from (select *, lag(b) over (partition by l_suppkey, l_partkey order by day) as b0 from y) group by 1, 2),
t as (select l_suppkey, day, sum(d) over (partition by l_suppkey order by day) as total from z)
select l_suppkey, day, round(total, 2) as total, round(max(total) over (partition by l_suppkey order by day), 2) as peak from t""",
    "j14_nearest": f"""
with h as (select hit_id, trim(qid, {_BL}) as k, ali_from::bigint as p from hmmer_dom_hits where qid is not null and ali_from is not null), e as (select distinct base_id as k, (orig_start + S_idx)::bigint as q from pooled_json where base_id is not null)
select hit_id, first(q order by abs(q - p), q) as nearest from h join e using (k) where q is not null group by hit_id""",
    "f25_json_field": "select event_type, count(try_cast(props ->> '$.k' as bigint)) as n, sum(try_cast(props ->> '$.k' as bigint))::bigint as total from events group by 1",
    "j2_semi": "select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey in (select r_regionkey from region where r_regionkey < 3))",
    "j9_listed": "select acc as base_id, reviewed, count(doc_id) as docs from reference_panel left join documents on acc = base_id group by 1, 2",
}
