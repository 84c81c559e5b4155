"""Queries of joins, summaries and samples over the remaining tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..operators import sampling
from ..operators import windows as W
from ..operators.coverage import trimmed
from ..operators.ranking import best_rows
from ..session import table


def pred11_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Accessions of the panel that documents contain, counted by accession."""
    found = J.mentions(table(spark, d, "documents"), "text", table(spark, d, "reference_panel"), "acc")
    return found.groupBy("acc").agg(F.count("*").alias("docs"))


def pred7_substring(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_manifest").filter(F.col("chunk_id").contains("chunk_0001_of")).select("row_id")


def pred10_truth(spark: SparkSession, d: str) -> DataFrame:
    """Labelled spans of chunks that have an entry."""
    t = table(spark, d, "label_table").filter("labels = 2 and use_span and S is not null and E is not null").select("row_id", trimmed(F.col("ids")).alias("chunk_id"), F.least("S", "E").alias("s"), F.greatest("S", "E").alias("e"))
    return t.join(table(spark, d, "pooled_json").select("chunk_id"), "chunk_id", "left_semi").select("row_id", "s", "e")


def pred12_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Hits that overlap the query's best hit, padded by 20."""
    h = table(spark, d, "hmmer_dom_hits").filter("qid is not null and ali_from is not null and ali_to is not null").select("hit_id", trimmed(F.col("qid")).alias("qid"), "i_evalue", F.least("ali_from", "ali_to").alias("s"), F.greatest("ali_from", "ali_to").alias("e"))
    best = best_rows(h, ["qid"], [F.asc_nulls_last("i_evalue"), F.asc("hit_id")]).select("qid", (F.col("s") - 20).alias("lo"), (F.col("e") + 20).alias("hi"))
    return h.join(best, "qid").filter("s <= hi and e >= lo").select("hit_id")


def j8_labelled_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries with every label of their chunk."""
    t = table(spark, d, "label_table").filter("labels is not null").select(trimmed(F.col("ids")).alias("chunk_id"), "labels")
    p = table(spark, d, "pooled_json").select("chunk_id", "P")
    return p.join(t, "chunk_id").groupBy("labels").agg(F.count("*").alias("n"), F.round(F.avg("P"), 6).alias("p"))


def j10_runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders with aggregates of their items, also those without."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("top"))
    o = table(spark, d, "orders")
    return o.join(items, o.o_orderkey == items.l_orderkey, "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), "top")


def j11_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Proteins of labels matched with sequences: equal ids, else the only one that contains the other."""
    a = table(spark, d, "label_table").filter("ids is not null").select(T.base_id(trimmed(F.col("ids"))).alias("base"))
    b = table(spark, d, "fasta_records").filter("seq_id is not null").select(trimmed(F.col("seq_id")).alias("seq_id"))
    return J.cascade_match(a, "base", b, "seq_id")


def j13_settings(spark: SparkSession, d: str) -> DataFrame:
    """Sequences and long sequences by backbone, with the settings."""
    f = table(spark, d, "fasta_records").select("backbone", F.length(T.strip_blanks(F.col("seq"))).alias("n"))
    s = table(spark, d, "chunk_settings")
    return f.join(s, "backbone").groupBy("backbone", "chunk_len").agg(F.count("*").alias("records"), F.count_if(F.col("n") > F.col("chunk_len")).alias("long"))


def a17_label_counts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "label_table").select("labels", F.coalesce("use_span", F.lit(False)).alias("use_span"), T.base_id(trimmed(F.col("ids"))).alias("b"))
    return x.groupBy("labels", "use_span").agg(F.count("*").alias("n"), F.countDistinct("b").alias("bases"))


def a27_fpr_at(spark: SparkSession, d: str) -> DataFrame:
    """The part of each source's ids that pass the thresholds of earlier runs."""
    v = F.col("value")
    s = table(spark, d, "fold_scores").filter("seq_id is not null").withColumn("id", trimmed(F.col("seq_id")))
    ok = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    best = s.groupBy("source", "id").agg(F.first("metric").alias("metric"), F.min(ok).alias("lo"), F.max(ok).alias("hi"))
    t = table(spark, d, "split_results").filter("threshold is not null").select("source", "threshold").distinct()
    good = F.coalesce(F.when(F.col("metric") == "evalue", F.col("lo") <= F.col("threshold")).otherwise(F.col("hi") >= F.col("threshold")), F.lit(False))
    return best.join(t, "source").groupBy("source", "threshold").agg(F.count_if(good).alias("passed"), F.count("*").alias("n"))


def a31_windowed(spark: SparkSession, d: str) -> DataFrame:
    """Entries by base and window of 500 positions: number, mean, spread and the first chunk."""
    x = table(spark, d, "pooled_json").filter("base_id is not null and orig_start is not null")
    key = F.floor(F.col("orig_start") / 500).cast("bigint").alias("window")
    return x.groupBy("base_id", key).agg(F.count("*").alias("n"), F.round(F.avg("P"), 9).alias("mean"), F.round(F.stddev_samp("P"), 9).alias("sd"), F.min("chunk_id").alias("first"))


def a43_small_groups(spark: SparkSession, d: str) -> DataFrame:
    """Isolates with fewer than five rows become unassigned."""
    x = table(spark, d, "label_table").filter("isolate is not null and isolate <> ''")
    n = x.groupBy("isolate").agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") >= 5, F.col("isolate")).otherwise("Unassigned").alias("isolate")).agg(F.sum("n").alias("rows"), F.count("*").alias("groups"))


def w15_regions(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 60 with stride 20 over each distinct entry's span, the last one clipped."""
    x = table(spark, d, "pooled_json").filter("S_idx is not null and E_idx is not null").select("entry_id", F.least("S_idx", "E_idx").alias("s"), (F.abs(F.col("E_idx") - F.col("S_idx")) + 1).alias("n")).distinct()
    y = x.select("entry_id", "s", "n", F.explode(W.window_starts(F.col("n"), 60, 40, "clipped")).alias("i"))
    return y.select("entry_id", (F.col("s") + F.col("i")).cast("bigint").alias("r_from"), (F.col("s") + F.least(F.col("i") + 60, F.col("n"))).cast("bigint").alias("r_to"))


def w17_batches(spark: SparkSession, d: str) -> DataFrame:
    """Sequences in micro-batches of at most 20,000 letters and 50 records; the batches' sizes."""
    x = table(spark, d, "fasta_records").select("rec_id", F.coalesce(F.length("seq"), F.lit(0)).alias("n"))
    y = W.greedy_batches(x, "n", "rec_id", 20_000, 50).withColumn("part", F.spark_partition_id())
    return y.groupBy("part", "batch").agg(F.count("*").alias("records"), F.sum(F.col("n") + 2).alias("letters"))


def l8_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """How many of five subsamples of 80 % each sequence is in."""
    b = F.explode(F.sequence(F.lit(0), F.lit(4)))
    x = table(spark, d, "fasta_records").select("rec_id", b.alias("b"))
    keep = F.conv(F.substring(F.md5(F.concat_ws("\t", F.col("b").cast("string"), F.col("rec_id").cast("string"))), 1, 8), 16, 10).cast("bigint") % 1000 < 800
    return x.groupBy("rec_id").agg(F.count_if(keep).alias("drawn"))


def l9_examples(spark: SparkSession, d: str) -> DataFrame:
    """Ten bases to look at: the best, the best long and the best late one, then the best others."""
    x = table(spark, d, "pooled_json").filter("base_id is not null and P is not null and not isnan(P)")
    x = x.select("base_id", "P", (F.col("L") >= 500).alias("long"), (F.col("orig_start") > 1000).alias("late"))
    return sampling.chosen_examples(x, "base_id", "P", ["long", "late"], 10)


QUERIES = {
    f.__name__: f
    for f in (
        pred7_substring, pred10_truth, pred11_mentions, pred12_overlap, j8_labelled_entries, j10_runs, j11_cascade, j13_settings, a17_label_counts, a27_fpr_at, a31_windowed, a43_small_groups, w15_regions, w17_batches, l8_bootstrap, l9_examples,
    )
}

_BL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BASE = f"case when contains(trim(ids, {_BL}), '|chunk_') then split_part(trim(ids, {_BL}), '|chunk_', 1) when contains(trim(ids, {_BL}), '_chunk_') then split_part(trim(ids, {_BL}), '_chunk_', 1) else trim(ids, {_BL}) end"
SQL = {
    "pred7_substring": "select row_id from chunk_manifest where contains(chunk_id, 'chunk_0001_of')",
    "pred10_truth": f"select row_id, least(S, E) as s, greatest(S, E) as e from label_table where labels = 2 and use_span and S is not null and E is not null and trim(ids, {_BL}) in (select chunk_id from pooled_json)",
    "pred11_mentions": "select acc, count(*) as docs from documents join reference_panel on contains(text, acc) group by acc",
    "pred12_overlap": f"""
with h as (select hit_id, trim(qid, {_BL}) as qid, i_evalue, least(ali_from, ali_to) as s, greatest(ali_from, ali_to) as e from hmmer_dom_hits where qid is not null and ali_from is not null and ali_to is not null),
b as (select qid, s - 20 as lo, e + 20 as hi from h qualify row_number() over (partition by qid order by i_evalue nulls last, hit_id) = 1)
select hit_id from h join b using (qid) where s <= hi and e >= lo""",
    "j8_labelled_entries": f"select labels, count(*) as n, round(avg(P), 6) as p from pooled_json p join label_table t on p.chunk_id = trim(t.ids, {_BL}) where labels is not null group by labels",
    "j10_runs": "select o_orderkey, count(l_orderkey) as n, max(l_quantity) as top from orders left join lineitem on o_orderkey = l_orderkey group by 1",
    "j11_cascade": f"""
with x as (select distinct {_BASE} as a from label_table where ids is not null), y as (select distinct trim(seq_id, {_BL}) as b from fasta_records where seq_id is not null),
r as (select a from x where a not in (select b from y)), f as (select a, count(*) as n, min(b) as b from r join y on a <> '' and b <> '' and (contains(b, a) or contains(a, b)) group by a)
select a as base, a as seq_id, 'exact' as how from x where a in (select b from y)
union all select r.a, case when n = 1 then b end, case when n = 1 then 'contained' when n > 1 then 'ambiguous' else 'none' end from r left join f using (a)""",
    "j13_settings": "select backbone, chunk_len, count(*) as records, count(*) filter (where length(regexp_replace(upper(seq), '[ \\t\\r\\n]', '', 'g')) > chunk_len) as long from fasta_records join chunk_settings using (backbone) group by 1, 2",
    "a17_label_counts": f"select labels, coalesce(use_span, false) as use_span, count(*) as n, count(distinct {_BASE}) as bases from label_table group by 1, 2",
    "a27_fpr_at": f"""
with b as (select source, trim(seq_id, {_BL}) as id, first(metric) as metric, min(value) filter (where isfinite(value)) as lo, max(value) filter (where isfinite(value)) as hi from fold_scores where seq_id is not null group by 1, 2),
t as (select distinct source, threshold from split_results where threshold is not null)
select source, threshold, count(*) filter (where case when metric = 'evalue' then lo <= threshold else hi >= threshold end) as passed, count(*) as n from b join t using (source) group by 1, 2""",
    "a31_windowed": "select base_id, floor(orig_start / 500)::bigint as \"window\", count(*) as n, round(avg(P), 9) as mean, round(stddev_samp(P), 9) as sd, min(chunk_id) as \"first\" from pooled_json where base_id is not null and orig_start is not null group by 1, 2",
    "a43_small_groups": "with n as (select isolate, count(*) as n from label_table where isolate is not null and isolate <> '' group by 1) select case when n >= 5 then isolate else 'Unassigned' end as isolate, sum(n)::bigint as rows, count(*) as groups from n group by 1",
    "w15_regions": """
with x as (select distinct entry_id, least(S_idx, E_idx) as s, abs(E_idx - S_idx) + 1 as n from pooled_json where S_idx is not null and E_idx is not null),
y as (select *, unnest(range(0, case when n <= 60 then 1 else ceil((n - 60) / 20)::bigint + 1 end)) * 20 as i from x)
select entry_id, (s + i)::bigint as r_from, (s + least(i + 60, n))::bigint as r_to from y""",
    "l8_bootstrap": "with x as (select rec_id, unnest(range(0, 5)) as b from fasta_records) select rec_id, count(*) filter (where ('0x' || substr(md5(b || chr(9) || rec_id), 1, 8))::bigint % 1000 < 800) as drawn from x group by 1",
}
