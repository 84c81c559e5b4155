"""Queries of functions, joins, labels, losses, samples and windows that no other module has, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import augment as A
from ..operators import evidence as E
from ..operators import intervals as I
from ..operators import joins as J
from ..operators import losses as L
from ..operators import metrics as M
from ..operators import model as Mo
from ..operators import pooling as Po
from ..operators import sampling as Sa
from ..operators import stats as S
from ..operators import windows as W
from ..operators.coverage import trimmed
from ..operators.ranking import best_rows
from ..session import table
from .spans import SQL as SPANS
from .spans import _H, _hits, _merge, i6_span_iou


def _r(x, digits: int = 6):
    return F.round(x, digits)


def f5_safe_names(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "fasta_records").filter("path is not null")
    return x.select("rec_id", T.safe_key(F.col("path")).alias("key"), T.safe_file_name(F.col("path")).alias("file"))


def f9_windows(spark: SparkSession, d: str) -> DataFrame:
    """Bounds read from names like window_10_20; others have none."""
    name = F.when(F.col("chunk_index") % 3 == 0, F.col("chunk_id")).otherwise(F.concat(F.lit("window_"), F.col("aa_start").cast("string"), F.lit("_"), F.col("aa_end").cast("string")))
    return table(spark, d, "chunk_manifest").select("row_id", T.window_bounds(name).alias("w")).select("row_id", "w.s", "w.e", "w.mid")


def f10_clamped(spark: SparkSession, d: str) -> DataFrame:
    """Alignment ends in three readings, moved into the query's length."""
    x = table(spark, d, "hmmer_dom_hits").filter("qlen is not null")
    spans = {m: N.clamped_span(N.one_based(F.col("ali_from"), F.col("ali_to"), m), F.col("qlen")) for m in ("closed1", "closed0", "open0")}
    return x.select("hit_id", *(s[k].cast("bigint").alias(f"{m}_{k}") for m, s in spans.items() for k in ("s", "e")))


def f15_confidence(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "hmmer_dom_hits")
    cov = (F.abs(F.col("ali_to") - F.col("ali_from")) + 1) / F.col("qlen")
    cut = F.least("ali_from", "ali_to") <= 1
    return x.select("hit_id", _r(N.evidence_confidence(F.col("i_evalue"), cov, F.lit(0.5), F.coalesce(cut, F.lit(False)))).alias("conf"), _r(N.hit_confidence(F.col("qlen") % 5)).alias("by_hits"))


def f17_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fasta_records").filter("seq is not null").select("rec_id", T.sequence_hash(F.col("seq")).alias("sha"))


def f27_formats(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as text with fixed decimals and back; empty for null."""
    x = table(spark, d, "pooled_json").select("entry_id", "exported_at", T.fixed_text(F.col("P"), 4).alias("t"), T.fixed_text(F.col("S_idx").cast("double"), 0).alias("s"))
    return x.select("entry_id", "exported_at", _r(T.to_number(F.col("t")), 4).alias("P"), T.to_integer(F.col("s")).cast("bigint").alias("S_idx"), (F.col("s") == "").alias("empty"))


def f28_models(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "fasta_records").select("rec_id", F.concat(F.lit(" "), F.upper("backbone")).alias("b"))
    return x.select("rec_id", T.model_name(F.col("b")).alias("model"), T.is_local_model(F.col("b")).alias("local"))


def f30_motifs(spark: SparkSession, d: str) -> DataFrame:
    """Middles of alignments, the description standing for a motif's letters, and orders that aren't ABC."""
    x = table(spark, d, "hmmer_dom_hits").filter("ali_from is not null")
    order = F.when(F.col("hit_id") % 4 == 0, "abc ").when(F.col("hit_id") % 4 == 1, "CAB").when(F.col("hit_id") % 4 == 2, ".")
    return x.select("hit_id", T.motif_centre(F.col("ali_from"), F.lit(""), F.col("description"), F.col("target_acc")).alias("centre"), T.noncanonical_order(order).alias("odd"))


def f31_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hmmer_dom_hits").select("hit_id", T.domain_label(F.col("description"), F.concat(F.lit(" "), F.col("target_name"), F.lit("  x"))).alias("label"))


def f32_token_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as sixteen tokens of four numbers, half of them lying by dimension and with two marks, repaired."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    turned = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get(F.col("embedding"), i * 4 + j)))
    x = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 2 == 0, tokens).otherwise(turned).alias("t"), F.when(F.col("vec_id") % 3 == 0, 16).otherwise(14).alias("n"))
    v = x.select("vec_id", N.token_vectors(F.col("t"), F.col("n"), 4).alias("v"))
    return v.select("vec_id", F.size("v").cast("bigint").alias("n"), _r(N.total(F.flatten("v")), 4).alias("total"))


def f33_fits(spark: SparkSession, d: str) -> DataFrame:
    """Criteria of a mean as the fit of prices, and sizes in GiB."""
    x = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.var_pop("l_extendedprice").alias("v"), F.sum("l_extendedprice").alias("b"))
    q = N.fit_quality(F.col("v") * F.col("n"), F.col("v") * F.col("n") * 2, F.col("n"), 1)
    return x.select("l_returnflag", q.alias("q"), _r(N.gib(F.col("b"))).alias("gib")).select("l_returnflag", "q.r2", _r(F.col("q.aic"), 2).alias("aic"), _r(F.col("q.bic"), 2).alias("bic"), "gib")


def pred3_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Documents about listed accessions, by a filter that reaches the scan."""
    return J.allowed(table(spark, d, "documents"), "base_id", table(spark, d, "reference_panel").select("acc")).select("doc_id", "base_id")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "label_table").filter("ids is not null").select("row_id", trimmed(F.col("ids")).alias("chunk_id"), "labels", "L", "S", "E", "use_span")


def j3_best_logits(spark: SparkSession, d: str) -> DataFrame:
    """Each labelled row with the largest logit of its chunk."""
    p = table(spark, d, "pooled_json").filter("logit is not null and not isnan(logit)").select("chunk_id", "entry_id", "logit", "exported_at")
    return J.with_best(_labels(spark, d), p, ["chunk_id"], [F.desc("logit"), F.asc("entry_id"), F.asc("exported_at")], ["entry_id", "logit"]).select("row_id", "entry_id", _r("logit").alias("logit"))


def j4_looked_up(spark: SparkSession, d: str) -> DataFrame:
    """Each hit with its model's length and, as a second look, its description."""
    m = table(spark, d, "domain_profiles")
    x = J.looked_up(table(spark, d, "hmmer_dom_hits").select("hit_id", "target_name"), "target_name", m, "target_name", "model_len", "model_len", F.lit(-1))
    x = J.looked_up(x, "target_name", m.filter("model_len >= 200"), "target_name", "description", "told")
    return x.select("hit_id", F.col("model_len").cast("bigint").alias("model_len"), "told")


def j5_listed_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits on sequences that exist and that entries are about, with the length of the sequence."""
    h = table(spark, d, "hmmer_dom_hits").filter("qid is not null").select("hit_id", trimmed(F.col("qid")).alias("qid"))
    e = table(spark, d, "pooled_json").filter("base_id is not null").select(F.col("base_id").alias("qid"))
    f = table(spark, d, "fasta_records").filter("seq_id is not null").select(trimmed(F.col("seq_id")).alias("qid"), F.length("seq").alias("n"))
    return h.join(e, "qid", "left_semi").join(f.groupBy("qid").agg(F.max("n").cast("bigint").alias("n")), "qid").select("hit_id", "n")


def j6_predictions(spark: SparkSession, d: str) -> DataFrame:
    """True spans with the predicted ones of their chunk, an empty list where there is none."""
    p = table(spark, d, "pooled_json").filter("S_idx is not null and E_idx is not null")
    x = J.with_lists(_labels(spark, d).filter("S is not null and E is not null"), "chunk_id", p, F.struct(F.least("S_idx", "E_idx").alias("s"), F.greatest("S_idx", "E_idx").alias("e")), "spans", "source")
    return x.select("row_id", F.size("spans").cast("bigint").alias("n"), F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["e"] - s["s"] + 1), F.lit(0)).alias("total"), "source")


def a9_modes(spark: SparkSession, d: str) -> DataFrame:
    """The four ways to pool the vectors of a label."""
    x = table(spark, d, "embeddings")
    w = F.pmod(F.col("vec_id"), F.lit(7))
    out = None
    for how in ("mean", "sum", "attn", "attn-norm"):
        one = Po.pool_rows(x, ["label"], "embedding", w, how).select("label", F.lit(how).alias("how"), F.transform("pooled", lambda v: F.round(v, 5) + F.lit(0.0)).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def a25_iou(spark: SparkSession, d: str) -> DataFrame:
    """Mean IoU of labelled spans and the share of at least 0.5, of chunks with and without a prediction."""
    return M.span_summary(i6_span_iou(spark, d), ["predicted"], "iou").select("predicted", "n", _r("mean_iou", 5).alias("mean_iou"), _r("iou_share").alias("iou_share"))


def a33_motifs(spark: SparkSession, d: str) -> DataFrame:
    """Places of alignments on their queries, in percent, and distances to the end, by target."""
    x = table(spark, d, "hmmer_dom_hits").filter("qlen > 0 and ali_from is not null")
    x = x.select("target_name", (100 * F.col("ali_from") / F.col("qlen")).alias("pct"), F.abs(F.col("qlen") - F.col("ali_from")).cast("double").alias("away"))
    return S.motif_summary(x, ["target_name"], "pct", "away").select("target_name", "n", *(_r(c, 4).alias(c) for c in ("mean_pct", "median_pct", "mean_distance", "median_distance")))


def a39_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return S.silhouette(table(spark, d, "embeddings"), "embedding", "label").select("n", _r("silhouette", 5).alias("silhouette"))


def a41_peaks(spark: SparkSession, d: str) -> DataFrame:
    """The largest running total of each supplier, and when it is first reached."""
    x = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.to_date("l_shipdate").alias("day"), "l_quantity").groupBy("l_suppkey", "l_partkey", "day").agg(F.max("l_quantity").alias("q"))
    y = W.monotone_totals(x, "l_suppkey", "l_partkey", "day", "q")
    return y.groupBy("l_suppkey").agg(_r(F.max("peak"), 2).alias("peak"), F.max_by("day", F.struct("total", -F.datediff("day", F.lit("1970-01-01")))).alias("day"))


def a45_losses(spark: SparkSession, d: str) -> DataFrame:
    """Losses of the labelled chunks' predictions."""
    p = table(spark, d, "pooled_json").filter("logit is not null and S_norm is not null and E_norm is not null and mu is not null and sigma is not null")
    x = J.with_best(_labels(spark, d).filter("labels is not null and L > 1"), p, ["chunk_id"], [F.asc("entry_id"), F.asc("exported_at")], ["logit", "S_norm", "E_norm", "mu", "sigma"]).filter("logit is not null and abs(logit) < double('inf')")
    s, e = F.least("S", "E") / (F.col("L") - 1), F.greatest("S", "E") / (F.col("L") - 1)
    use = F.coalesce(F.col("use_span") & s.isNotNull() & e.isNotNull(), F.lit(False))
    z, y = F.col("logit"), F.col("labels")
    rows = {"pu": L.nonnegative_pu(z, y, 0.1), "clean": L.clean_negative(z, y), "span": L.span_loss(F.col("S_norm"), F.col("E_norm"), s, e, use), "anchor": L.anchor_loss(F.col("mu"), F.col("sigma"), s, e, use)}
    return x.agg(*(_r(c, 5).alias(n) for n, c in rows.items()))


def l8_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Five samples of 0.3 of the vectors each."""
    return Sa.bootstrap(table(spark, d, "embeddings"), "vec_id", 0.3, 5, 100).groupBy("iteration").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids")).select(F.col("iteration").cast("bigint").alias("iteration"), "n", "ids")


def l10_peek(spark: SparkSession, d: str) -> DataFrame:
    return Sa.peek(table(spark, d, "embeddings"), "vec_id", 7, 3)


def l11_crops(spark: SparkSession, d: str) -> DataFrame:
    """Crops, dropped tokens and noise, by what must hold of them for any draw."""
    x = table(spark, d, "pooled_json").filter("L > 0 and S_norm is not null and E_norm is not null").select("entry_id", "exported_at", "L", F.least("S_norm", "E_norm").alias("s"), F.greatest("S_norm", "E_norm").alias("e"))
    key = F.col("entry_id")
    middle = F.floor((N.span_index(F.col("s"), F.col("L")) + N.span_index(F.col("e"), F.col("L"))) / 2)
    x = x.select("entry_id", "exported_at", "L", middle.alias("m"), A.random_crop(F.col("L"), 100, 5, key).alias("r"), A.span_crop(F.col("L"), 100, F.col("s"), F.col("e"), 5, key).alias("c"), A.kept_tokens(F.least("L", F.lit(300)), 0.3, 5, key, middle, 5).alias("k"))
    size = F.least(F.col("L"), F.lit(100))
    inside = lambda c: (F.col(f"{c}.start") >= 0) & (F.col(f"{c}.end") <= F.col("L"))
    return x.select(
        "entry_id", "exported_at", (F.col("r.end") - F.col("r.start")).cast("bigint").alias("random_size"), (F.col("c.end") - F.col("c.start")).cast("bigint").alias("span_size"),
        (inside("r") & inside("c") & (F.col("m") >= F.col("c.start")) & (F.col("m") < F.col("c.end"))).alias("ok"), ((F.size("k") == F.least("L", F.lit(300))) & F.exists("k", lambda v: v) & F.coalesce(F.get("k", F.col("m").cast("int")), F.lit(True))).alias("kept"), (size == F.col("r.end") - F.col("r.start")).alias("whole"),
    )


def w14_best_window(spark: SparkSession, d: str) -> DataFrame:
    """Of each sequence the window of 100 letters with the most K, windows by steps of 60 and one at the end."""
    x = table(spark, d, "fasta_records").filter("seq is not null").select("rec_id", T.sanitised(F.col("seq")).alias("s")).withColumn("n", F.length("s"))
    part = F.substr(F.col("s"), F.col("w_start") + 1, F.col("w_end") - F.col("w_start"))
    score = F.length(part) - F.length(F.translate(part, "K", ""))
    y = W.best_windows(x, ["rec_id"], "n", 100, 60, score)
    return y.select("rec_id", *(F.col(c).cast("bigint").alias(c) for c in ("w_start", "w_end", "score")))


def i10_decisions(spark: SparkSession, d: str) -> DataFrame:
    """A label and a code for each sequence: hits of Palm models, scores as the annotation with spans of entries, and all other hits as other domains, of two kinds by their accession."""
    seqs = table(spark, d, "fasta_records").filter("seq_id is not null").select(trimmed(F.col("seq_id")).alias("qid"), F.length("seq").alias("n")).groupBy("qid").agg(F.max("n").cast("bigint").alias("length"))
    h = _hits(spark, d)
    palm = h.filter(F.col("target_name").startswith("Palm") & (F.col("i_evalue") <= 1e-5))
    best = palm.groupBy("qid").agg(F.min_by(F.struct("s", "e"), F.struct("i_evalue", "hit_id")).alias("hs"))
    rest = h.filter(~F.col("target_name").startswith("Palm") & (F.col("i_evalue") <= 1e-3) & (F.col("s") < F.col("e")))
    covered = I.union_length(rest, ["qid"]).withColumnRenamed("length", "covered")
    kinds = rest.groupBy("qid").agg(F.max(F.coalesce(F.col("target_acc_base").startswith("PF"), F.lit(False))).alias("pfam"), F.max(~F.coalesce(F.col("target_acc_base").startswith("PF"), F.lit(False))).alias("other"))
    score = table(spark, d, "fold_scores").filter((F.col("metric") == "score") & (F.abs("value") < float("inf"))).groupBy(trimmed(F.col("seq_id")).alias("qid")).agg(F.max("value").alias("score"))
    e = table(spark, d, "pooled_json").filter("base_id is not null").select(F.col("base_id").alias("qid"), "entry_id", "exported_at", (F.col("orig_start") + F.col("S_idx") + 1).alias("lo"), (F.col("orig_start") + F.col("E_idx") + 1).alias("hi"))
    spans = best_rows(e, ["qid"], [F.asc("entry_id"), F.asc("exported_at")]).select("qid", E.chosen_span(F.col("lo"), F.col("hi"), F.col("lo"), F.lit(None).cast("int")).alias("c"))
    over = lambda s, n: E.overlap_with_span(rest, s, "qid").withColumnRenamed("overlap", n)
    x = seqs
    hit_spans = best.select("qid", "hs.s", "hs.e").filter("s < e")
    span_rows = spans.filter("c.source <> ''").select("qid", (F.col("c.lo") - 1).alias("s"), F.col("c.hi").alias("e"))
    for side in (best, covered, kinds, score, spans, over(hit_spans, "ho"), over(span_rows, "so")):
        x = x.join(side, "qid", "left")
    full = F.col("covered") / F.nullif(F.col("length"), F.lit(0)) >= 0.5
    code = E.decision(
        F.col("hs").isNotNull(), E.conflict(F.col("ho"), F.col("hs.e") - F.col("hs.s"), 20, 0.25), F.col("score"), F.col("score") >= 75, F.col("c.source"),
        E.conflict(F.col("so"), F.col("c.hi") - F.col("c.lo") + 1, 20, 0.25), full,
    )
    x = x.withColumn("code", code)
    return x.select("qid", F.left("code", F.lit(1)).alias("label"), "code", F.when(F.coalesce(full, F.lit(False)), E.source_names({"pfam": F.col("pfam"), "other": F.col("other")})).otherwise("").alias("sources"), F.coalesce("ho", F.lit(0)).alias("hit_overlap"), F.coalesce("so", F.lit(0)).alias("span_overlap"))


def t4_failures(spark: SparkSession, d: str) -> DataFrame:
    """Sequences scored by an embedder that fails on some: their batch is tried again one by one, and only they have an error."""
    good = Mo.hash_embedder(4)

    def embed(seqs: list[str]) -> list:
        if any(s.startswith(("A", "G")) for s in seqs):
            raise RuntimeError("refused")
        return good(seqs)

    x = table(spark, d, "fasta_records").select("rec_id", F.left(T.sanitised(F.col("seq")), F.lit(40)).alias("s"))
    p = Mo.score_chunks(x, "rec_id", "s", embed, Mo.Weights.random(4, 1, (16, 12, 8)), 400, 2, 0.0)
    return p.select("rec_id", F.col("P").isNotNull().alias("scored"), F.when(F.col("error").contains("refused"), "refused").otherwise(F.col("error")).alias("error"))


QUERIES = {
    f.__name__: f
    for f in (
        t4_failures, f5_safe_names, f9_windows, f10_clamped, f15_confidence, f17_hashes, f27_formats, f28_models, f30_motifs, f31_labels, f32_token_vectors, f33_fits, pred3_allowed, j3_best_logits, j4_looked_up, j5_listed_hits, j6_predictions,
        a9_modes, a25_iou, a33_motifs, a39_silhouette, a41_peaks, a45_losses, l8_drawn, l10_peek, l11_crops, w14_best_window, i10_decisions,
    )
}

_BL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LAB = f"l as (select row_id, trim(ids, {_BL}) as chunk_id, labels, L, S, E, use_span from label_table where ids is not null)"


def _clamped(m: str, a: int, b: int) -> str:
    s, e = f"greatest(1, least(least(ali_from + {a}, ali_to + {b}), qlen))", f"greatest(1, least(greatest(ali_from + {a}, ali_to + {b}), qlen))"
    ok = "ali_from is not null and ali_to is not null and qlen > 0"
    return f"case when {ok} then {s} end::bigint as {m}_s, case when {ok} then {e} end::bigint as {m}_e"


def _mean(value: str, where: str) -> str:
    return f"coalesce(avg({value}) filter (where {where}), 0)"


def _smooth(x: str, beta: float) -> str:
    return f"case when abs({x}) < {beta} then 0.5 * ({x}) * ({x}) / {beta} else abs({x}) - {beta / 2} end"


_POOL = """
x as (select label, vec_id, unnest(range(0, 64)) as i, unnest(embedding)::double as x, (vec_id % 7)::double as w from embeddings),
g as (select label, i, avg(x) as m, sum(x) as s, sum(w * x) as a, case when sum(w) > 0 then sum(w * x) / sum(w) else avg(x) end as n from x group by 1, 2)
"""
SQL = {
    "f5_safe_names": "select rec_id, replace(path, '/', '_') as key, regexp_replace(path, '[^\\p{L}\\p{N}._-]', '_', 'g') as file from fasta_records where path is not null",
    "t4_failures": "with x as (select rec_id, left(regexp_replace(regexp_replace(upper(seq), '[ \\t\\r\\n]', '', 'g'), '[^ACDEFGHIKLMNPQRSTVWYX]', 'X', 'g'), 40) as s from fasta_records) select rec_id, coalesce(s <> '' and left(s, 1) not in ('A', 'G'), false) as scored, case when s is null or s = '' then 'empty sequence' when left(s, 1) in ('A', 'G') then 'refused' end as error from x",
    "f9_windows": "select row_id, s, e, (s + e) / 2 as mid from (select row_id, case when chunk_index % 3 = 0 then null else aa_start::double end as s, case when chunk_index % 3 = 0 then null else aa_end::double end as e from chunk_manifest where chunk_index % 3 = 0 or (aa_start is not null and aa_end is not null)) union all select row_id, null, null, null from chunk_manifest where chunk_index is null or (chunk_index % 3 <> 0 and (aa_start is null or aa_end is null))",
    "f10_clamped": f"select hit_id, {_clamped('closed1', 0, 0)}, {_clamped('closed0', 1, 1)}, {_clamped('open0', 1, 0)} from hmmer_dom_hits where qlen is not null",
    "f15_confidence": """
with x as (select hit_id, case when i_evalue is null then 0 else -log10(case when i_evalue <= 0 then 1e-300 else i_evalue end) end as s, coalesce((abs(ali_to - ali_from) + 1) / nullif(qlen, 0), 0) as c, coalesce(least(ali_from, ali_to) <= 1, false) as cut, coalesce(qlen % 5, 0) as k from hmmer_dom_hits)
select hit_id, round((0.6 * greatest(0.0, least(1.0, (s - 3.0) / 27.0)) + 0.3 * greatest(0.0, least(1.0, c / 0.6)) + 0.1 * 0.5) * case when cut then 0.5 else 1.0 end, 6) as conf, round(greatest(0.0, least(1.0, ln(1.0 + k) / ln(4.0))), 6) as by_hits from x""",
    "f17_hashes": "select rec_id, sha256(seq) as sha from fasta_records where seq is not null",
    "f27_formats": "select entry_id, exported_at, round(P::varchar::decimal(24, 12), 4)::double as P, S_idx::bigint as S_idx, S_idx is null as empty from pooled_json",
    "f28_models": """
with x as (select rec_id, ' ' || upper(backbone) as b, lower(backbone) as n from fasta_records)
select rec_id, case when n in ('300m', 'esmc_300m', 'esmc-300m') then 'esmc_300m' when n in ('600m', 'esmc_600m', 'esmc-600m') then 'esmc_600m' when n in ('6b', 'esmc_6b', 'esmc-6b', 'esmc-6b-2024-12') then 'esmc-6b-2024-12' else b end as model,
  coalesce(n in ('esmc_300m', 'esmc_600m', 'esmc-300m', 'esmc-600m'), false) as local from x""",
    "f30_motifs": "select hit_id, ali_from + coalesce((length(coalesce(nullif(description, ''), nullif(target_acc, ''))) - 1) / 2.0, 0) as centre, hit_id % 4 = 1 as odd from hmmer_dom_hits where ali_from is not null",
    "f31_labels": "select hit_id, trim(regexp_replace(coalesce(case when trim(description) not in ('', '-') then description end, ' ' || target_name || '  x'), '\\s+', ' ', 'g')) as label from hmmer_dom_hits",
    "f32_token_vectors": "select vec_id, case when vec_id % 3 = 0 then 16 else 14 end::bigint as n, round(case when vec_id % 3 = 0 then list_sum(embedding::double[]) else list_sum(embedding[5:60]::double[]) end, 4) as total from embeddings",
    "f33_fits": "select l_returnflag, 0.5::double as r2, round(count(*) * ln(var_pop(l_extendedprice)) + 2, 2) as aic, round(count(*) * ln(var_pop(l_extendedprice)) + ln(count(*)), 2) as bic, round(sum(l_extendedprice) / 1073741824.0, 6) as gib from lineitem group by 1",
    "pred3_allowed": "select doc_id, base_id from documents where base_id in (select acc from reference_panel)",
    "j3_best_logits": f"with {_LAB}, p as (select * from pooled_json where logit is not null and not isnan(logit) qualify row_number() over (partition by chunk_id order by logit desc, entry_id, exported_at) = 1) select row_id, entry_id, round(logit, 6) as logit from l left join p using (chunk_id)",
    "j4_looked_up": "select hit_id, coalesce(model_len, -1)::bigint as model_len, case when model_len >= 200 then p.description end as told from hmmer_dom_hits h left join domain_profiles p using (target_name)",
    "j5_listed_hits": f"with f as (select trim(seq_id, {_BL}) as qid, max(length(seq))::bigint as n from fasta_records where seq_id is not null group by 1) select hit_id, n from hmmer_dom_hits h join f on trim(h.qid, {_BL}) = f.qid where f.qid in (select base_id from pooled_json where base_id is not null)",
    "j6_predictions": f"with {_LAB}, p as (select distinct chunk_id, least(S_idx, E_idx) as s, greatest(S_idx, E_idx) as e from pooled_json where S_idx is not null and E_idx is not null), q as (select chunk_id, count(*) as n, sum(e - s + 1) as t from p group by 1) select row_id, coalesce(n, 0) as n, coalesce(t, 0)::bigint as total, case when n is null then 'missing' else 'found' end as source from l left join q using (chunk_id) where S is not null and E is not null",
    "a9_modes": f"with {_POOL}, u as (select label, 'mean' as how, i, m as v from g union all select label, 'sum', i, s from g union all select label, 'attn', i, a from g union all select label, 'attn-norm', i, n from g) select label, how, list(round(v, 5) + 0.0 order by i) as v from u group by 1, 2",
    "a33_motifs": "with x as (select target_name, 100 * ali_from / qlen as p, abs(qlen - ali_from)::double as a from hmmer_dom_hits where qlen > 0 and ali_from is not null) select target_name, count(*) as n, round(avg(p), 4) as mean_pct, round(median(p), 4) as median_pct, round(avg(a), 4) as mean_distance, round(median(a), 4) as median_distance from x group by 1",
    "a39_silhouette": """
with p as (select a.vec_id as i, a.label as c, b.label as o, avg(list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda q: (q[1] - q[2]) * (q[1] - q[2])))) filter (where a.vec_id <> b.vec_id) as d from embeddings a, embeddings b group by 1, 2, 3),
s as (select i, max(d) filter (where c = o) as a, min(d) filter (where c <> o) as b, count(*) as k from p group by 1)
select count(*) as n, round(avg(case when a is null then 0.0 else (b - a) / greatest(a, b) end), 5) as silhouette from s""",
    "a41_peaks": """
with x as (select l_suppkey, l_partkey, l_shipdate::date as day, max(l_quantity) as q from lineitem group by 1, 2, 3), b as (select *, max(q) over (partition by l_suppkey, l_partkey order by day) as m from x),
r as (select l_suppkey, day, m - coalesce(lag(m) over (partition by l_suppkey, l_partkey order by day), 0) as d from b), g as (select l_suppkey, day, sum(d) as d from r group by 1, 2), t as (select l_suppkey, day, sum(d) over (partition by l_suppkey order by day) as t from g)
select l_suppkey, round(max(t), 2) as peak, arg_max(day, t * 1000000 - epoch(day) / 86400.0) as day from t group by 1""",
    "a45_losses": f"""
with {_LAB}, p as (select * from pooled_json where logit is not null and S_norm is not null and E_norm is not null and mu is not null and sigma is not null qualify row_number() over (partition by chunk_id order by entry_id, exported_at) = 1),
x as (select l.labels as y, p.logit as z, p.S_norm as s, p.E_norm as e, p.mu, p.sigma, least(l.S, l.E) / (l.L - 1) as a, greatest(l.S, l.E) / (l.L - 1) as b, coalesce(l.use_span and l.S is not null and l.E is not null, false) as u from l join p using (chunk_id) where l.labels is not null and l.L > 1 and isfinite(p.logit)),
c as (select *, greatest(z, 0) + ln(1 + exp(-abs(z))) as neg, greatest(z, 0) - z + ln(1 + exp(-abs(z))) as pos, greatest(least(e, b) - greatest(s, a), 0.0) as i from x), k as (select *, greatest(e - s, 0.0) + greatest(b - a, 0.0) - i as v from c)
select round(0.1 * {_mean('pos', 'y = 2')} + greatest({_mean('neg', 'y = 1')} - 0.1 * {_mean('neg', 'y = 2')}, 0), 5) as pu, round({_mean('neg', 'y = 0')}, 5) as clean,
  round({_mean(_smooth('s - a', 0.1), 'u')} + {_mean(_smooth('e - b', 0.1), 'u')} + {_mean('1 - case when v > 0 then i / v else 0 end', 'u')}, 5) as span,
  round(0.1 * {_mean(_smooth('mu - (a + b) / 2', 0.2), 'u')} + 0.1 * {_mean(_smooth('sigma - (b - a) / 4', 0.2), 'u')}, 5) as anchor from k""",
    "l8_drawn": "with x as (select vec_id, unnest(range(0, 5)) as b from embeddings), r as (select *, row_number() over (partition by b order by md5((100 + b)::varchar || chr(9) || vec_id), vec_id) as n, count(*) over (partition by b) as k from x) select b as iteration, count(*) as n, sum(vec_id)::bigint as ids from r where n <= greatest(2, round_even(0.3 * k, 0)) group by 1",
    "l10_peek": "select vec_id from (select vec_id from embeddings order by md5('3' || chr(9) || vec_id), vec_id limit 7)",
    "l11_crops": "select entry_id, exported_at, least(L, 100)::bigint as random_size, least(L, 100)::bigint as span_size, true as ok, true as kept, true as whole from pooled_json where L > 0 and S_norm is not null and E_norm is not null",
    "w14_best_window": """
with q as (select rec_id, regexp_replace(regexp_replace(upper(seq), '[ \t\r\n]', '', 'g'), '[^ACDEFGHIKLMNPQRSTVWYX]', 'X', 'g') as s from fasta_records where seq is not null), n as (select rec_id, s, length(s) as n from q where length(s) > 0),
w as (select rec_id, s, n, unnest(case when n <= 100 then [0] else list_distinct(list_concat(list_transform(range(0, (n - 100) // 60 + 1), lambda i: i * 60), [n - 100])) end) as a from n),
c as (select rec_id, a, least(a + 100, n) as b, length(substr(s, a + 1, least(a + 100, n) - a)) - length(replace(substr(s, a + 1, least(a + 100, n) - a), 'K', '')) as k from w)
select rec_id, a::bigint as w_start, b::bigint as w_end, k::bigint as score from c qualify row_number() over (partition by rec_id order by k desc, a) = 1""",
    "i10_decisions": f"""with {_H}, l as (select trim(seq_id, {_BL}) as qid, max(length(seq))::bigint as length from fasta_records where seq_id is not null group by 1),
b as (select qid, first(s order by i_evalue, hit_id) as s, first(e order by i_evalue, hit_id) as e from h where starts_with(target_name, 'Palm') and i_evalue <= 1e-5 group by qid),
r as (select * from h where not starts_with(target_name, 'Palm') and i_evalue <= 1e-3 and s < e), {_merge('m', 'r', 'qid', 0)},
c as (select qid, sum(e - s) as covered from m group by qid), k as (select qid, bool_or(coalesce(starts_with(target_acc_base, 'PF'), false)) as ver, bool_or(not coalesce(starts_with(target_acc_base, 'PF'), false)) as pla from r group by qid),
v as (select trim(seq_id, {_BL}) as qid, max(value) as score from fold_scores where metric = 'score' and isfinite(value) and seq_id is not null group by 1),
e0 as (select base_id as qid, orig_start + S_idx as s, orig_start + E_idx + 1 as e from pooled_json where base_id is not null qualify row_number() over (partition by base_id order by entry_id, exported_at) = 1),
sp as (select * from e0 where e > s and e - s between 30 and 400),
ho as (select m.qid, sum(least(m.e, b.e) - greatest(m.s, b.s))::bigint as ho from m join b on m.qid = b.qid and m.s < b.e and b.s < m.e group by m.qid),
so as (select m.qid, sum(least(m.e, sp.e) - greatest(m.s, sp.s))::bigint as so from m join sp on m.qid = sp.qid and m.s < sp.e and sp.s < m.e group by m.qid),
x as (select l.qid, b.qid is not null as hit, coalesce(ho, 0) as ho, coalesce(so, 0) as so, score, coalesce(score >= 75, false) as strong, sp.qid is not null as usable, coalesce(coalesce(ho, 0) >= 20 and coalesce(ho, 0) >= 0.25 * (b.e - b.s), false) as clash,
  coalesce(coalesce(so, 0) >= 20 and coalesce(so, 0) >= 0.25 * (sp.e - sp.s), false) as sclash, coalesce(covered / nullif(length, 0) >= 0.5, false) as ful, ver, pla
  from l left join b using (qid) left join c using (qid) left join k using (qid) left join v using (qid) left join sp using (qid) left join ho using (qid) left join so using (qid)),
y as (select *, case when hit and strong and usable and not sclash then case when clash then 'P_RESCUED_BY_CLEAN_PALM_SPAN' else 'P_CONSENSUS_CLEAN_PP' end when ful and not hit and not strong then 'N_NONRDRP_PFAM_OR_CDD_DOMINANT'
  when hit and strong and usable then 'U_PALM_SPAN_CONFLICTS_WITH_NONRDRP_PFAM_OR_CDD' when hit and strong then 'U_NO_USABLE_PALM_SPAN' when hit and clash then 'U_RDRPCATCH_CONFLICTS_WITH_NONRDRP_PFAM_OR_CDD'
  when hit and ful then 'U_FULL_NONRDRP_BUT_RDRPCATCH_POSITIVE' when hit then 'U_RDRPCATCH_ONLY_OR_LOW_PALM_SCORE' when strong then 'U_PALMANNOT_ONLY' when score > 0 then 'U_PALMANNOT_LOW_SCORE_ONLY' else 'U_NO_HIGH_CONFIDENCE_SIGNAL' end as code from x)
select qid, left(code, 1) as label, code, case when ful then array_to_string(list_filter([case when ver then 'pfam' end, case when pla then 'other' end], lambda z: z is not null), '+') else '' end as sources, ho as hit_overlap, so as span_overlap from y""",
}
SQL["a25_iou"] = f"select predicted, count(*) as n, round(avg(iou), 5) as mean_iou, round(avg((iou >= 0.5)::int), 6) as iou_share from ({SPANS['i6_span_iou']}) where iou is not null group by predicted"
