"""Round trips through file formats and micro-batches, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coverage import trimmed
from ..sources import fasta, sinks, tabular
from ..session import scratch, table
from ..streaming import pipeline


def sc1_fasta(spark: SparkSession, d: str) -> DataFrame:
    """Sequences written as FASTA and read again."""
    path = scratch(spark, "fasta")
    x = table(spark, d, "fasta_records").filter("seq is not null").select(F.col("rec_id").cast("string").alias("id"), F.regexp_replace("seq", r"\s", "").alias("s"))
    sinks.write_fasta(x, path, "id", "s", 60)
    y = fasta.read_fasta(spark, path)
    return y.select(F.col("seq_id").cast("bigint").alias("rec_id"), F.length("seq").cast("bigint").alias("len"), F.md5("seq").alias("md5"))


def sc18_domtblout(spark: SparkSession, d: str) -> DataFrame:
    """Hits written as a table of domains and read again."""
    path = scratch(spark, "domtbl")
    h = table(spark, d, "hmmer_dom_hits").filter("qid is not null and trim(qid) <> '' and ali_from is not null and ali_to is not null")
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("-"))
    dash = F.lit("-")
    fields = [c("target_name"), c("target_acc"), dash, F.trim("qid"), dash, c("qlen"), *[dash] * 6, c("i_evalue"), *[dash] * 4, c("ali_from"), c("ali_to"), c("env_from"), c("env_to"), dash, c("description")]
    h.select(F.concat_ws("  ", *fields).alias("value")).write.text(path)
    return tabular.read_domtblout(spark, path).groupBy("qid").agg(F.count("*").alias("n"), F.min("i_evalue").alias("best"), F.sum(F.col("ali_to") - F.col("ali_from")).alias("total"), F.max(F.length("description")).cast("bigint").alias("longest"))


def sc23_scores(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "scores")
    x = table(spark, d, "fold_scores").filter("metric = 'evalue' and seq_id is not null")
    x.select(F.concat_ws("\t", trimmed(F.col("seq_id")), F.coalesce(F.col("value").cast("string"), F.lit("value"))).alias("value")).write.text(path)
    return tabular.read_scores(spark, path, low_is_good=True)


def sk2_gff3(spark: SparkSession, d: str) -> DataFrame:
    """Features of entries with P of at least 0.5, written and read again."""
    path = scratch(spark, "gff")
    x = table(spark, d, "pooled_json").filter("base_id is not null and S_idx is not null and E_idx is not null")
    x = x.select("base_id", (F.col("orig_start") + F.least("S_idx", "E_idx") + 1).alias("start"), (F.col("orig_start") + F.greatest("S_idx", "E_idx") + 1).alias("end"), "P", "entry_id")
    sinks.write_gff3(x, path, least_p=0.5, extra=["entry_id"])
    y = tabular.read_gff3(spark, path, "RdRP_domain")
    return y.select("seqid", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "score", F.try_element_at("attrs", F.lit("entry_id")).cast("bigint").alias("entry_id"))


def sk5_json(spark: SparkSession, d: str) -> DataFrame:
    """Logits written as JSON lines and read again."""
    path = scratch(spark, "json")
    x = table(spark, d, "pooled_json").select("entry_id", "chunk_id", "logit", "temperature")
    sinks.write_json(x, path + "/rows", {"schema": x.schema.simpleString()})
    return spark.read.schema("entry_id bigint, chunk_id string, logit double, temperature double").json(path + "/rows/*.json")


def sk6_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, d, "pooled_json").select("entry_id", "chunk_id", "P", "mu"), path, {"P": 4, "mu": 4})
    x = spark.read.option("header", True).csv(path)
    return x.select(F.col("entry_id").cast("bigint").alias("entry_id"), "chunk_id", F.col("P").cast("double").alias("P"), F.col("mu").cast("double").alias("mu"))


def sk14_sharded(spark: SparkSession, d: str) -> DataFrame:
    """FASTA in a folder for each backbone."""
    path = scratch(spark, "shards")
    x = table(spark, d, "fasta_records").filter("seq is not null and backbone is not null").select(F.col("rec_id").cast("string").alias("id"), F.regexp_replace("seq", r"\s", "").alias("s"), "backbone")
    sinks.write_fasta(x, path, "id", "s", 0, by=["backbone"], most_records=500)
    y = fasta.read_fasta(spark, path + "/*")
    return y.groupBy(F.regexp_extract("path", r"backbone=([^/]+)/", 1).alias("backbone")).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("letters"))


def t1_micro_batches(spark: SparkSession, d: str) -> DataFrame:
    """Events streamed file by file into JSON lines, then counted."""
    path = scratch(spark, "stream")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, d, "events").schema)
    stream = pipeline.file_stream(spark, f"{d}/[e]vents.parquet", schema)
    pipeline.run_batches(stream, lambda b: b.filter("value >= 10").select("event_id", "event_type", "value"), path + "/out", path + "/state").awaitTermination()
    x = spark.read.schema("event_id bigint, event_type string, value double").json(path + "/out/*")
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def t2_best_so_far(spark: SparkSession, d: str) -> DataFrame:
    """The best event of each user by keyed state; its last update is the result."""
    path = scratch(spark, "best")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, d, "events").schema)
    best = pipeline.best_so_far(pipeline.file_stream(spark, f"{d}/[e]vents.parquet", schema, 100), "user_id", "value", "event_type")

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/{number}")

    best.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", path + "/state").trigger(availableNow=True).start().awaitTermination()
    x = spark.read.schema("key string, P double, row string, batch int").parquet(path + "/out/*")
    return x.groupBy(F.col("key").cast("bigint").alias("user_id")).agg(F.max_by("P", "batch").alias("best"))


def pred4_resume(spark: SparkSession, d: str) -> DataFrame:
    """Labelled chunks that no entry has yet."""
    todo = table(spark, d, "label_table").filter("ids is not null").select("row_id", trimmed(F.col("ids")).alias("chunk_id"))
    return pipeline.resume(todo, table(spark, d, "pooled_json"), "chunk_id")


QUERIES = {f.__name__: f for f in (sc1_fasta, sc18_domtblout, sc23_scores, sk2_gff3, sk5_json, sk6_csv, sk14_sharded, t1_micro_batches, t2_best_so_far, pred4_resume)}

_BL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_S = "regexp_replace(seq, '\\s', '', 'g')"
SQL = {
    "sc1_fasta": f"select rec_id, length({_S})::bigint as len, md5({_S}) as md5 from fasta_records where seq is not null",
    "sc18_domtblout": f"""
select trim(qid, {_BL}) as qid, count(*) as n, min(i_evalue) as best, sum(ali_to - ali_from)::bigint as total, max(length(description))::bigint as longest from hmmer_dom_hits
where qid is not null and trim(qid) <> '' and ali_from is not null and ali_to is not null and i_evalue is not null group by 1""",
    "sc23_scores": f"select trim(seq_id, {_BL}) as seq_id, min(case when value <= 0 then 1e-300 else value end) as value from fold_scores where metric = 'evalue' and seq_id is not null and isfinite(value) group by 1",
    "sk2_gff3": "select base_id as seqid, orig_start::bigint + least(S_idx, E_idx) + 1 as start, orig_start::bigint + greatest(S_idx, E_idx) + 1 as end, round(P, 6) as score, entry_id from pooled_json where base_id is not null and S_idx is not null and E_idx is not null and P >= 0.5",
    "sk5_json": "select entry_id, chunk_id, logit, temperature from pooled_json",
    "sk6_csv": "select entry_id, chunk_id, round(P::varchar::decimal(24, 12), 4)::double as P, round(mu::varchar::decimal(24, 12), 4)::double as mu from pooled_json",
    "sk14_sharded": f"select backbone, count(*) as n, sum(length({_S}))::bigint as letters from fasta_records where seq is not null and backbone is not null group by 1",
    "t1_micro_batches": "select event_type, count(*) as n, round(sum(value), 4) as total from events where value >= 10 group by 1",
    "t2_best_so_far": "select user_id, max(value) as best from events group by 1",
    "pred4_resume": f"select row_id, trim(ids, {_BL}) as chunk_id from label_table where ids is not null and trim(ids, {_BL}) not in (select chunk_id from pooled_json where chunk_id is not null)",
}
