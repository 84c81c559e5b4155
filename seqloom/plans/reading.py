"""Round trips of the remaining readers and writers over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import intervals as I
from ..operators import metrics as M
from ..operators.coverage import trimmed
from ..session import scratch, table
from ..sources import fasta, items, sinks, tabular


def _r(x, digits: int = 6):
    return F.round(x, digits)


def _lines(df: DataFrame, name: str, *columns: Column | str, head: str | None = None, between: str = "\t") -> str:
    """The columns as lines of text, null as an empty field; with a head, every file begins with it."""
    path = scratch(df.sparkSession, name)
    cells = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    value = F.concat_ws(between, *cells)
    rows = df.select(value.alias("value"))
    if head is not None:
        rows = df.sparkSession.createDataFrame([(head,)], "value string").unionByName(rows)
    rows.write.text(path)
    return path


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fasta_records").select(F.col("rec_id").cast("string").alias("id"), F.coalesce(F.regexp_replace("seq", r"\s", ""), F.lit("")).alias("s"))


def _written(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "fasta")
    sinks.write_fasta(_sequences(spark, d), path, "id", "s", 70)
    return path


def sc2_records(spark: SparkSession, d: str) -> DataFrame:
    """All records, those without sequence included, by strict reading."""
    x = fasta.read_fasta(spark, _written(spark, d), strict=True)
    return x.select(F.col("seq_id").cast("bigint").alias("rec_id"), F.length("seq").cast("bigint").alias("n"))


def sc3_not_empty(spark: SparkSession, d: str) -> DataFrame:
    return fasta.read_fasta(spark, _written(spark, d), empty="drop").select(F.col("seq_id").cast("bigint").alias("rec_id"))


def sc4_printable(spark: SparkSession, d: str) -> DataFrame:
    x = fasta.read_fasta(spark, _written(spark, d), clean="printable")
    return x.select(F.col("seq_id").cast("bigint").alias("rec_id"), F.md5("seq").alias("md5"))


def sc5_headers(spark: SparkSession, d: str) -> DataFrame:
    """Whole headers of more than one word."""
    x = table(spark, d, "fasta_records").select(F.concat(F.lit(">"), F.col("rec_id").cast("string"), F.lit(" about "), F.coalesce("backbone", F.lit("none"))).alias("h"))
    y = fasta.read_fasta(spark, _lines(x, "headers", "h", F.lit("MKV"), between="\n"), strict=True)
    return y.select(F.col("seq_id").cast("bigint").alias("rec_id"), "header", "seq")


def sc6_gzip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "gz")
    x = _sequences(spark, d).select(sinks.fasta_rows(F.col("id"), F.col("s"), 60).alias("value"))
    x.write.option("compression", "gzip").text(path)
    return fasta.read_fasta(spark, path).select(F.col("seq_id").cast("bigint").alias("rec_id"), F.length("seq").cast("bigint").alias("n"))


def sc7_count(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(fasta.count_records(spark, _written(spark, d)),)], "n bigint")


def sc9_lengths(spark: SparkSession, d: str) -> DataFrame:
    return fasta.lengths(spark, _written(spark, d)).groupBy("length").agg(F.count("*").alias("n")).select(F.col("length").cast("bigint").alias("length"), "n")


def sc10_fetched(spark: SparkSession, d: str) -> DataFrame:
    """Records by a list of ids: those that have labels or stand in the manifest with one chunk."""
    ids = table(spark, d, "fasta_records").filter("length(seq) > 1000").select(F.col("rec_id").cast("string"))
    return fasta.fetch(fasta.read_fasta(spark, _written(spark, d)), ids).select(F.col("seq_id").cast("bigint").alias("rec_id"), F.length("seq").cast("bigint").alias("n"))


def _items(spark: SparkSession, d: str) -> str:
    """Vectors as items of sixteen tokens of four numbers, every third without its last token."""
    path = scratch(spark, "items")
    emb = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i < 15) | (F.col("vec_id") % 3 != 0))
    x = table(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"), "vec_id", emb.alias("emb"), mask.alias("mask"), F.when(F.col("vec_id") % 2 == 0, 7).alias("orig_aa_start"))
    items.write_items(x, path, buckets=4)
    return path


def sc11_items(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with the position channel behind the numbers, masked ones left out."""
    x = items.read_items(spark, _items(spark, d))
    last = N.total(F.transform("tokens", lambda t: F.element_at(t, -1)))
    return x.select("vec_id", F.col("L").cast("bigint").alias("n"), F.size(F.get("tokens", F.lit(0))).cast("bigint").alias("width"), _r(last, 4).alias("places"), _r(N.total(F.flatten("tokens")) - last, 4).alias("total"), F.coalesce("orig_start", F.lit(0)).cast("bigint").alias("start"))


def sc12_labelled(spark: SparkSession, d: str) -> DataFrame:
    """Items with their labels, by label."""
    labels = table(spark, d, "embeddings").filter("vec_id % 5 <> 0").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"), "label")
    x = items.labelled_items(items.read_items(spark, _items(spark, d)), labels)
    return x.groupBy("label").agg(F.count("*").alias("n"), F.sum("L").alias("tokens"))


def sc13_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of labels by maps of both directions and by none."""
    x = table(spark, d, "label_table")
    texts = {"a": '{"0": "neg", "1": "unl", "2": "pos"}', "b": '{"neg": 0, "pos": 2}', "c": "not json"}
    return x.select("row_id", *(items.label_name(F.col("labels"), items.label_map(t)).alias(c) for c, t in texts.items()))


def sc14_sets(spark: SparkSession, d: str) -> DataFrame:
    """Two files of vectors, read as one set."""
    x = table(spark, d, "embeddings")
    parts = []
    for k in (0, 1):
        path = _lines(x.filter(F.col("vec_id") % 3 != k), "vectors", F.concat(F.lit("v"), F.col("vec_id").cast("string")), *(F.get("embedding", F.lit(i)).cast("double") for i in range(64)))
        parts.append(tabular.read_vectors(spark, path))
    return items.vector_sets(parts).groupBy("id").agg(F.count("*").alias("n"), _r(F.avg(N.norm(F.col("v"))), 5).alias("norm"))


def sc16_catch(spark: SparkSession, d: str) -> DataFrame:
    """Hits as a table with a repeated header, of each query the best."""
    h = table(spark, d, "hmmer_dom_hits").filter("qid is not null and trim(qid) <> '' and ali_from is not null and ali_to is not null")
    x = h.select(trimmed(F.col("qid")).alias("q"), F.col("qlen").alias("n"), F.col("i_evalue").alias("ev"), F.col("hit_id").alias("b"), "ali_from", "ali_to")
    head = "Sequence_name\tseq_len\tevalue\tbitscore\tfrom\tto"
    return tabular.read_catch(spark, _lines(x, "catch", "q", "n", "ev", "b", "ali_from", "ali_to", head=head)).select("qid", "evalue", F.col("bitscore").cast("bigint").alias("hit_id"), "start", "end")


def sc17_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Entries as lines of key=value, of each base the best."""
    x = table(spark, d, "pooled_json").filter("base_id is not null and P is not null and not isnan(P)")
    kv = lambda k, c: F.concat(F.lit(f"{k}="), F.col(c).cast("string"))
    y = tabular.read_annotations(spark, _lines(x, "kv", "base_id", F.concat(F.lit("rdrp="), F.round(F.col("P") * 100, 3).cast("string")), kv("pp_lo", "S_idx"), kv("pp_hi", "E_idx"), F.lit("seqA=")))
    return y.select("qid", "score")


def sc19_fmt6(spark: SparkSession, d: str) -> DataFrame:
    """Hits of six and of fourteen columns."""
    h = table(spark, d, "hmmer_dom_hits").filter("qid is not null and trim(qid) <> '' and ali_from is not null and ali_to is not null")
    path = _lines(h, "fmt6", trimmed(F.col("qid")), "target_name", "i_evalue", "hit_id", "ali_from", "ali_to", F.lit("1"), F.lit("9"), F.lit(""), "qlen", F.lit("x"), "description", F.lit("1.5"), F.lit("-"))
    x = tabular.read_fmt6(spark, path)
    return x.groupBy("qid").agg(F.count("*").alias("n"), F.sum("qlen").alias("qlens"), F.count("slen").alias("known"), F.sum(F.col("qend") - F.col("qstart")).alias("total"))


def sc20_accessions(spark: SparkSession, d: str) -> DataFrame:
    """Accessions without versions, from a list with comments and repeated rows."""
    x = table(spark, d, "domain_profiles").select(F.concat(F.col("target_acc_base"), F.lit(".7")).alias("a"))
    return tabular.read_accessions(spark, _lines(x.unionByName(x), "accessions", "a", head="# accessions"))


def sc21_mixed_ids(spark: SparkSession, d: str) -> DataFrame:
    """A list of ids of chunks and of whole sequences, in two sets."""
    x = table(spark, d, "label_table").filter("ids is not null").select(trimmed(F.col("ids")).alias("i")).filter((F.col("i") != "") & ~F.col("i").rlike(r"[\s,]") & ~F.col("i").startswith("#"))
    chunks, others = tabular.split_ids(tabular.read_ids(spark, _lines(x, "ids", "i", head="chunk_id")))
    return chunks.withColumn("kind", F.lit("chunk")).unionByName(others.withColumn("kind", F.lit("whole")))


def sc22_listed(spark: SparkSession, d: str) -> DataFrame:
    """Ids before a comma, with a header."""
    x = table(spark, d, "reference_panel").select("acc", "aa_len")
    return tabular.read_ids(spark, _lines(x, "list", "acc", "aa_len", head="id,len", between=","))


def sc25_truth(spark: SparkSession, d: str) -> DataFrame:
    """True spans by chunk in two readings of their ends, moved into the chunk and merged."""
    x = table(spark, d, "label_table").filter("ids is not null and use_span and labels = 2 and S is not null and E is not null and L > 0").select(trimmed(F.col("ids")).alias("chunk_id"), "S", "E", "L")
    out = None
    for mode in ("closed0", "open0"):
        span = N.clamped_span(N.one_based(F.col("S"), F.col("E"), mode), F.col("L"))
        one = I.merge(x.select("chunk_id", span.alias("p")).select("chunk_id", "p.s", "p.e"), ["chunk_id"], touch=1).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out.select("mode", "chunk_id", F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"))


def sc26_objects(spark: SparkSession, d: str) -> DataFrame:
    """Entries as JSON objects of records, one a file, with notes about the file."""
    path = scratch(spark, "objects")
    x = table(spark, d, "pooled_json").filter("logit is not null").groupBy("entry_id").agg(F.max("logit").alias("logit"), F.max("L").alias("L"))
    record = F.concat(F.lit('"'), F.col("entry_id").cast("string"), F.lit('": '), F.to_json(F.struct("logit", "L")))
    y = x.groupBy((F.col("entry_id") % 20).alias("g")).agg(F.concat(F.lit('{"_meta": {"L": 0}, '), F.array_join(F.collect_list(record), ", "), F.lit("}")).alias("value"))
    y.select("value", "g").write.partitionBy("g").text(path)
    z = tabular.read_record_objects(spark, path, "logit: double, L: bigint")
    return z.select(F.col("key").cast("bigint").alias("entry_id"), _r("logit").alias("logit"), "L")


def sc28_regions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "hmmer_dom_hits").filter("env_from is not null and env_to is not null")
    y = tabular.read_regions(spark, _lines(x, "regions", "target_name", F.concat(F.lit("r"), F.col("hit_id").cast("string")), "env_from", "env_to", head="pattern\tname\tstart1\tend1"))
    return y.select("name", F.col("start1").cast("bigint").alias("start1"), F.col("end1").cast("bigint").alias("end1"))


def sc29_interpro(spark: SparkSession, d: str) -> DataFrame:
    """Distinct annotations of one database that have an entry."""
    x = table(spark, d, "hmmer_dom_hits").filter("qid is not null and trim(qid) <> '' and ali_from is not null and ali_to is not null")
    db, ipr = F.when(F.col("hit_id") % 2 == 0, "Pfam").otherwise("CDD"), F.when(F.col("hit_id") % 3 == 0, "-").otherwise(F.col("target_acc_base"))
    path = _lines(x, "ipr", trimmed(F.col("qid")), F.lit("m"), F.lit("9"), db, "target_name", F.lit("d"), "ali_from", "ali_to", F.lit("0"), F.lit("T"), F.lit("x"), ipr, F.lit("e"), F.lit("-"), F.lit("-"))
    return tabular.read_interpro(spark, path, ["Pfam"]).groupBy("ipr").agg(F.count("*").alias("n"), F.countDistinct("acc").alias("seqs"))


def sc31_log(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of earlier runs as a JSON log, read with its needed columns."""
    path = scratch(spark, "log")
    x = table(spark, d, "split_results").filter("threshold is not null").select(F.struct(F.monotonically_increasing_id().alias("epoch"), "source", "threshold").alias("r"))
    x.agg(F.to_json(F.struct(F.collect_list("r").alias("log"))).alias("value")).coalesce(1).write.text(path)  # 46 rows
    return tabular.read_training_log(spark, path, ["epoch", "threshold"]).groupBy("source").agg(F.count("*").alias("n"), _r(F.sum("threshold"), 5).alias("total"))


def sc33_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The chunk manifest written by tabs with a header and read again."""
    path = scratch(spark, "manifest")
    x = table(spark, d, "chunk_manifest").filter("chunk_id is not null and chunk_index is not null")
    x = x.select("chunk_id", "orig_id", "chunk_index", "chunks_total", F.col("aa_start").alias("orig_aa_start"), F.col("aa_end").alias("orig_aa_end"), "chunk_aa_len", "orig_aa_len")
    sinks.write_layout(x, path, "manifest")
    y = tabular.read_manifest(spark, path)
    return y.groupBy("chunk_id").agg(F.count("*").alias("n"), F.count("orig_id").alias("known"), F.sum("orig_aa_end").alias("ends"))


def sk3_full_features(spark: SparkSession, d: str) -> DataFrame:
    """Features with all attributes, read again."""
    path = scratch(spark, "full")
    x = table(spark, d, "pooled_json").filter("base_id is not null and S_idx is not null and E_idx is not null and P >= 0.7 and chunk_id is not null")
    x = x.select("base_id", "chunk_id", (F.least("S_idx", "E_idx") + 1).alias("start"), (F.greatest("S_idx", "E_idx") + 1).alias("end"), "P", "logit", "calibrated_logit", "sigma", F.col("L").alias("length"), F.lit(0.5).alias("entropy"))
    sinks.write_gff3(x, path, full=True, least_p=0.8)
    y = tabular.read_gff3(spark, path, "RdRP_domain")
    get = lambda k: F.try_element_at("attrs", F.lit(k))
    return y.groupBy(F.col("seqid").alias("base_id")).agg(F.count("*").alias("n"), F.max(F.size("attrs")).cast("bigint").alias("attributes"), F.max(get("Chunk")).alias("chunk"), F.sum(get("len").cast("bigint")).alias("length"), F.max(get("AttnMass")).alias("mass"))


def sk7_records(spark: SparkSession, d: str) -> DataFrame:
    """The record of each base by tabs with fixed decimals."""
    path = scratch(spark, "records")
    x = table(spark, d, "pooled_json").filter("base_id is not null and P is not null").groupBy("base_id").agg(F.max("P").alias("P"))
    sinks.write_layout(x, path, "records")
    y = spark.read.option("sep", "\t").option("header", True).csv(path)
    return y.select("base_id", F.col("P").cast("double").alias("P"))


def sk8_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Items in two runs: the second adds only what the first lacks."""
    path = scratch(spark, "runs")
    x = table(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"), "vec_id", "embedding")
    items.write_items(x.filter("vec_id % 3 = 0"), path, buckets=4)
    todo = items.missing_items(x, spark, path).withColumn("run", F.lit(2))
    items.write_items(todo, path, buckets=4)
    return spark.read.option("mergeSchema", True).parquet(path).groupBy(F.coalesce("run", F.lit(1)).cast("bigint").alias("run")).agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"))


def sk9_unique(spark: SparkSession, d: str) -> DataFrame:
    """Span vectors under keys that are unique."""
    x = table(spark, d, "pooled_json").filter("chunk_id is not null").select("chunk_id", "entry_id", "exported_at")
    return items.unique_keys(x, "chunk_id", ["entry_id", "exported_at"]).select("entry_id", "exported_at", "item")


def sk10_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels with their counts, as the notes beside them say."""
    path = scratch(spark, "labels")
    meta = sinks.write_labels(table(spark, d, "label_table").filter("labels is not null").select("row_id", F.col("labels").alias("label")), path, {"by": "rows"})
    return spark.createDataFrame([(int(k), n) for k, n in meta["counts"].items()], "label bigint, n bigint")


def sk12_matrix(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "matrix")
    sinks.write_matrix(table(spark, d, "embeddings"), path, "vec_id", "embedding", 64)
    y = spark.read.option("sep", "\t").option("header", True).csv(path)
    total = sum((F.col(f"v{i}").cast("double") for i in range(64)), F.lit(0.0))
    return y.select(F.col("vec_id").cast("bigint").alias("vec_id"), _r(total, 4).alias("total"))


def sk13_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Links of hits' targets as a sparse matrix: weights are shared queries."""
    path = scratch(spark, "sparse")
    x = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    e = x.alias("a").join(x.alias("b"), F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey"))
    sinks.write_sparse_rows(e.select(F.col("a.n_nationkey").cast("bigint").alias("src"), F.col("b.n_nationkey").cast("bigint").alias("dst"), F.lit(0.5).alias("weight")), path)
    return spark.read.parquet(path).select("node", "indices", F.size("weights").cast("bigint").alias("n"))


def sk15_curves(spark: SparkSession, d: str) -> DataFrame:
    """Curves of events' values by tabs and back."""
    path = scratch(spark, "curves")
    c = M.curves(M.score_counts(table(spark, d, "events").select(F.round("value", 0).alias("value"), "event_type"), [], "value", F.col("event_type") == "click"), [])
    sinks.write_layout(c, path, "curves")
    y = spark.read.option("sep", "\t").option("header", True).csv(path)
    return y.select(*(F.col(k).cast("double").alias(k) for k in ("score", "recall", "precision", "fpr")))


def sk16_points(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "points")
    x = table(spark, d, "split_results").filter("threshold is not null and train_fpr is not null").select("source", "mode", F.col("target_fpr").alias("target"), "threshold", F.col("train_fpr").alias("fpr"))
    sinks.write_layout(x, path, "operating_points")
    y = spark.read.option("sep", "\t").option("header", True).csv(path)
    return y.groupBy("source", "mode").agg(F.count("*").alias("n"), _r(F.sum(F.col("fpr").cast("double")), 4).alias("fpr"))


QUERIES = {
    f.__name__: f
    for f in (
        sc2_records, sc3_not_empty, sc4_printable, sc5_headers, sc6_gzip, sc7_count, sc9_lengths, sc10_fetched, sc11_items, sc12_labelled, sc13_names, sc14_sets, sc16_catch, sc17_annotations, sc19_fmt6, sc20_accessions, sc21_mixed_ids,
        sc22_listed, sc25_truth, sc26_objects, sc28_regions, sc29_interpro, sc31_log, sc33_manifest, sk3_full_features, sk7_records, sk8_resumed, sk9_unique, sk10_labels, sk12_matrix, sk13_sparse, sk15_curves, sk16_points,
    )
}

_BL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_S = "coalesce(regexp_replace(seq, '\\s', '', 'g'), '')"
_HITS = f"h as (select *, trim(qid, {_BL}) as q from hmmer_dom_hits where qid is not null and trim(qid) <> '' and ali_from is not null and ali_to is not null)"


def _span(a: int, b: int) -> str:
    low, high = f"least(S + {a}, E + {b})", f"greatest(S + {a}, E + {b})"
    return f"greatest(1, least({low}, L)) as s, greatest(1, least({high}, L)) as e"


SQL = {
    "sc2_records": f"select rec_id, length({_S})::bigint as n from fasta_records",
    "sc3_not_empty": f"select rec_id from fasta_records where {_S} <> ''",
    "sc4_printable": f"select rec_id, md5(regexp_replace(regexp_replace(upper({_S}), '[^\\x21-\\x7E]', '', 'g'), '\\*', '', 'g')) as md5 from fasta_records",
    "sc5_headers": "select rec_id, rec_id || ' about ' || coalesce(backbone, 'none') as header, 'MKV' as seq from fasta_records",
    "sc6_gzip": f"select rec_id, length({_S})::bigint as n from fasta_records",
    "sc7_count": "select count(*) as n from fasta_records",
    "sc9_lengths": f"select length({_S})::bigint as length, count(*) as n from fasta_records group by 1",
    "sc10_fetched": f"select rec_id, length({_S})::bigint as n from fasta_records where length(seq) > 1000",
    "sc11_items": "select vec_id, case when vec_id % 3 = 0 then 15 else 16 end::bigint as n, 5::bigint as width, case when vec_id % 3 = 0 then 7.5 else 8.0 end::double as places, round(case when vec_id % 3 = 0 then list_sum(embedding[1:60]::double[]) else list_sum(embedding::double[]) end, 4) as total, case when vec_id % 2 = 0 then 7 else 0 end::bigint as start from embeddings",
    "sc12_labelled": "select label, count(*) as n, sum(case when vec_id % 3 = 0 then 15 else 16 end)::bigint as tokens from embeddings where vec_id % 5 <> 0 group by 1",
    "sc13_names": "select row_id, case labels when 0 then 'neg' when 1 then 'unl' when 2 then 'pos' end as a, case labels when 0 then 'neg' when 2 then 'pos' end as b, case labels when 0 then 'N' when 1 then 'U' when 2 then 'P' end as c from label_table",
    "sc14_sets": "select 'v' || vec_id as id, case when vec_id % 3 = 2 then 2 else 1 end::bigint as n, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm from embeddings",
    "sc16_catch": f"with {_HITS} select q as qid, i_evalue as evalue, hit_id, ali_from as start, ali_to as end from h qualify row_number() over (partition by q order by i_evalue nulls last, hit_id desc) = 1",
    "sc17_annotations": "select base_id as qid, round(max(round(P * 100, 3)), 3) as score from pooled_json where base_id is not null and P is not null and not isnan(P) group by 1",
    "sc19_fmt6": f"with {_HITS} select q as qid, count(*) as n, sum(qlen)::bigint as qlens, 0::bigint as known, sum(ali_to - ali_from)::bigint as total from h group by 1",
    "sc20_accessions": "select distinct target_acc_base as id from domain_profiles where target_acc_base is not null",
    "sc21_mixed_ids": f"with x as (select distinct trim(ids, {_BL}) as id from label_table where ids is not null) select id, case when regexp_matches(id, '[|_]chunk_\\d+_of_\\d+') then 'chunk' else 'whole' end as kind from x where id <> '' and not regexp_matches(id, '[\\s,]') and not starts_with(id, '#')",
    "sc22_listed": "select acc as id from reference_panel",
    "sc26_objects": "select entry_id, round(max(logit), 6) as logit, max(L)::bigint as L from pooled_json where logit is not null group by 1",
    "sc28_regions": "select 'r' || hit_id as name, least(env_from, env_to)::bigint as start1, greatest(env_from, env_to)::bigint as end1 from hmmer_dom_hits where env_from is not null and env_to is not null",
    "sc29_interpro": f"with {_HITS}, x as (select distinct q, target_name, ali_from, ali_to, target_acc_base as ipr from h where hit_id % 2 = 0 and hit_id % 3 <> 0 and target_acc_base is not null) select ipr, count(*) as n, count(distinct q) as seqs from x group by 1",
    "sc31_log": "select source, count(*) as n, round(sum(threshold), 5) as total from split_results where threshold is not null group by 1",
    "sc33_manifest": "select chunk_id, count(*) as n, count(nullif(orig_id, '')) as known, sum(aa_end)::bigint as ends from chunk_manifest where chunk_id is not null and chunk_index is not null group by 1",
    "sk3_full_features": "select base_id, count(*) as n, 12::bigint as attributes, max(chunk_id) as chunk, sum(L)::bigint as length, '0.90' as mass from pooled_json where base_id is not null and S_idx is not null and E_idx is not null and P >= 0.8 and chunk_id is not null group by 1",
    "sk7_records": "select base_id, round(max(P)::varchar::decimal(24, 12), 6)::double as P from pooled_json where base_id is not null and P is not null group by 1",
    "sk8_resumed": "select case when vec_id % 3 = 0 then 1 else 2 end::bigint as run, count(*) as n, count(*) as ids from embeddings group by 1",
    "sk9_unique": "select entry_id, exported_at, chunk_id || case when n = 1 then '' else '__' || (n - 1) end as item from (select *, row_number() over (partition by chunk_id order by entry_id, exported_at) as n from pooled_json where chunk_id is not null)",
    "sk10_labels": "select labels::bigint as label, count(*) as n from label_table where labels is not null group by 1",
    "sk12_matrix": "select vec_id, round(list_sum(embedding::double[]), 4) as total from embeddings",
    "sk13_sparse": "select a.n_nationkey::bigint as node, list(b.n_nationkey::bigint order by b.n_nationkey) as indices, count(*) as n from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey group by 1",
    "sk15_curves": """
with c as (select round(value, 0) as score, count(*) filter (where event_type = 'click') as tp, count(*) as n from events where value is not null and not isnan(value) group by 1),
s as (select score, sum(tp) over w as tps, sum(n) over w as ns, sum(tp) over () as pos, sum(n) over () as total from c window w as (order by score desc))
select score, round(tps / pos, 6) as recall, round(tps / ns, 6) as precision, round((ns - tps) / (total - pos), 6) as fpr from s""",
    "sk16_points": "select source, mode, count(*) as n, round(sum(round(train_fpr, 6)), 4) as fpr from split_results where threshold is not null and train_fpr is not null group by 1, 2",
}
_LAB = f"x as (select trim(ids, {_BL}) as chunk_id, S, E, L from label_table where ids is not null and use_span and labels = 2 and S is not null and E is not null and L > 0)"
SQL["sc25_truth"] = f"""with {_LAB}, p as (select 'closed0' as mode, chunk_id, {_span(1, 1)} from x union all select 'open0', chunk_id, {_span(1, 0)} from x),
a as (select *, max(e) over (partition by mode, chunk_id order by s, e rows between unbounded preceding and 1 preceding) as m from p), b as (select *, sum(case when m is null or s > m + 1 then 1 else 0 end) over (partition by mode, chunk_id order by s, e rows unbounded preceding) as r from a)
select mode, chunk_id, min(s)::bigint as s, max(e)::bigint as e from b group by mode, chunk_id, r"""
