"""Readers of tool outputs: tolerant of bad rows, typed, and read by Spark's text, CSV and JSON sources.

Fields that are missing, empty, `-` or of another type are null; rows without an id are left out.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import accession_base, key_values, to_integer, to_number
from ..operators.ranking import best_rows

Paths = str | Sequence[str]


def _lines(spark: SparkSession, paths: Paths, comments: bool = True) -> DataFrame:
    """(value, path, n): lines that aren't blank, nor comments; n orders the lines of a file."""
    x = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    x = x.select(F.btrim("value", F.lit("\r")).alias("value"), F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start")).alias("b"), F.monotonically_increasing_id().alias("m"))
    x = x.select("value", "path", F.struct("path", "b", "m").alias("n")).filter(F.trim("value") != "")
    return x.filter(~F.col("value").startswith("#")) if comments else x


def _fields(kinds: str, parts: Column) -> list[Column]:
    """Columns of `name:kind` by position; kinds s, i, d."""
    out = []
    for i, item in enumerate(kinds.split()):
        name, kind = item.split(":")
        raw = F.get(parts, F.lit(i))
        value = {"s": F.nullif(F.nullif(F.trim(raw), F.lit("")), F.lit("-")), "i": to_integer(raw), "d": to_number(raw)}[kind]
        out.append(value.alias(name))
    return out


def read_catch(spark: SparkSession, paths: Paths, dedupe: bool = True) -> DataFrame:
    """Profile hits with a header, which may be repeated: of each sequence the hit of the least e-value, then the best score and coverage."""
    # Columns of the tool's output.
    need = ["Sequence_name", "evalue", "bitscore", "from", "to"]
    lines = _lines(spark, paths, comments=False)
    first = lines.filter(F.col("value").startswith("Sequence_name")).limit(1).collect()
    header = first[0].value.split("\t") if first else []
    missing = [c for c in need if c not in header]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    parts = F.split("value", "\t")
    at = {c: F.get(parts, F.lit(i)) for i, c in enumerate(header)}
    num = lambda c: to_number(at[c]) if c in at else F.lit(None).cast("double")
    x = lines.select(
        "n", F.trim(at["Sequence_name"]).alias("qid"), num("seq_len").try_cast("int").alias("seq_len"), num("evalue").alias("evalue"), num("bitscore").alias("bitscore"), to_integer(at["from"]).alias("start"), to_integer(at["to"]).alias("end"), num("profile_cov").alias("profile_cov"), num("seq_cov").alias("seq_cov")
    ).filter("qid <> '' and qid <> 'Sequence_name'")
    if dedupe:
        x = best_rows(x, ["qid"], [F.asc_nulls_last("evalue"), F.desc_nulls_last("bitscore"), F.desc_nulls_last("seq_cov"), F.asc("n")])
    return x.drop("n")


def read_annotations(spark: SparkSession, paths: Paths, dedupe: bool = True) -> DataFrame:
    """(qid, kv, score, pp_lo, pp_hi, ext_lo, ext_hi, motifs) of headerless lines `id<TAB>k=v...`; of each id the best score, then the most usable spans and motifs."""
    x = _lines(spark, paths).select("n", F.trim(F.substring_index("value", "\t", 1)).alias("qid"), key_values(F.col("value")).alias("kv")).filter("qid <> ''")
    get = lambda k: F.try_element_at("kv", F.lit(k))
    x = x.select("n", "qid", "kv", to_number(get("rdrp")).alias("score"), *(to_integer(get(k)).alias(k) for k in ("pp_lo", "pp_hi", "ext_lo", "ext_hi")), (sum((get(f"seq{m}").isNotNull().cast("int") for m in "ABC"), F.lit(0))).alias("motifs"))
    if dedupe:
        ok = lambda a: F.coalesce((F.col(f"{a}_hi") >= F.col(f"{a}_lo")).cast("int"), F.lit(0))
        x = best_rows(x, ["qid"], [F.desc_nulls_last("score"), ok("pp").desc(), ok("ext").desc(), F.desc("motifs"), F.asc("n")])
    return x.drop("n")


def read_domtblout(spark: SparkSession, paths: Paths) -> DataFrame:
    """Domain hits: fields by white space, at least 22, the rest the description; other lines are left out."""
    x = _lines(spark, paths).select(F.split(F.trim("value"), r"\s+", 23).alias("p")).filter(F.size("p") >= 22)
    at = lambda i: F.get("p", F.lit(i))
    return x.select(
        at(0).alias("target_name"), F.nullif(at(1), F.lit("-")).alias("target_acc"), accession_base(at(1)).alias("target_acc_base"), at(3).alias("qid"), to_integer(at(5)).alias("qlen"), to_number(at(12)).alias("i_evalue"),
        to_integer(at(17)).alias("ali_from"), to_integer(at(18)).alias("ali_to"), to_integer(at(19)).alias("env_from"), to_integer(at(20)).alias("env_to"), F.nullif(at(22), F.lit("-")).alias("description"),
    ).filter("i_evalue is not null and ali_from is not null and ali_to is not null")


def read_fmt6(spark: SparkSession, paths: Paths) -> DataFrame:
    """Alignment hits of 14 tab-separated columns, of which the first six are needed."""
    x = _lines(spark, paths).select(F.split("value", "\t").alias("p")).filter(F.size("p") >= 6)
    # Columns of the tool's output, in order.
    kinds = "qid:s sid:s evalue:d bitscore:d qstart:i qend:i sstart:i send:i len:i qlen:i slen:i title:s qcovs:d qcovhsp:d"
    return x.select(*_fields(kinds, F.col("p"))).filter("qid is not null and qstart is not null and qend is not null")


def read_ids(spark: SparkSession, paths: Paths, pattern: str | None = None) -> DataFrame:
    """(id): distinct first fields (separated by tabs, commas or white space) without comments and headers `id`, `chunk_id`, `seq_id`; with `pattern` its first group."""
    field = F.regexp_extract(F.trim("value"), pattern or r"^([^\s,]+)", 1)
    x = _lines(spark, paths).select(field.alias("id"))
    return x.filter((F.col("id") != "") & ~F.lower("id").isin("id", "chunk_id", "seq_id")).distinct()


def read_accessions(spark: SparkSession, paths: Paths) -> DataFrame:
    """(id): accessions without versions."""
    return read_ids(spark, paths).select(accession_base(F.col("id")).alias("id")).distinct()


def split_ids(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ids of chunks, and those of whole sequences."""
    chunk = F.col("id").rlike(r"[|_]chunk_\d+_of_\d+")
    return ids.filter(chunk), ids.filter(~chunk)


def read_scores(spark: SparkSession, paths: Paths, low_is_good: bool = False) -> DataFrame:
    """(seq_id, value): the best finite value of each id; lines without a number (headers) are left out, e-values of 0 or less become 1e-300."""
    x = _lines(spark, paths).select(F.split("value", r"\t").alias("p")).select(*_fields("seq_id:s value:d", F.col("p"))).filter("seq_id is not null and value is not null and not isnan(value) and abs(value) < double('inf')")
    if low_is_good:
        return x.groupBy("seq_id").agg(F.min(F.when(F.col("value") <= 0, 1e-300).otherwise(F.col("value"))).alias("value"))
    return x.groupBy("seq_id").agg(F.max("value").alias("value"))


def read_folds(spark: SparkSession, paths: Paths) -> DataFrame:
    """(seq_id, fold): lines without a whole number (headers) are left out; of repeated ids the last counts."""
    x = _lines(spark, paths).select("n", F.split("value", r"\t").alias("p")).select("n", *_fields("seq_id:s fold:i", F.col("p"))).filter("seq_id is not null and fold is not null")
    return x.groupBy("seq_id").agg(F.max_by("fold", "n").alias("fold"))


def read_gff3(spark: SparkSession, paths: Paths, feature: str | None = None) -> DataFrame:
    """Features with their attributes as a map; ends in order."""
    x = _lines(spark, paths).select(F.split("value", "\t").alias("p")).filter(F.size("p") >= 9)
    x = x.select(*_fields("seqid:s source:s type:s a:i b:i score:d strand:s phase:s", F.col("p")), key_values(F.get("p", F.lit(8)), ";").alias("attrs"))
    x = x.filter("seqid is not null and a is not null and b is not null")
    x = x.select("seqid", "source", "type", F.least("a", "b").alias("start"), F.greatest("a", "b").alias("end"), F.when(F.col("score").isNotNull(), F.col("score")).alias("score"), "strand", "phase", "attrs")
    return x.filter(F.col("type") == feature) if feature else x


def read_regions(spark: SparkSession, paths: Paths) -> DataFrame:
    """(pattern, name, start1, end1), ends in order."""
    x = _lines(spark, paths).select(F.split("value", r"\t").alias("p")).select(*_fields("pattern:s name:s a:i b:i", F.col("p"))).filter("pattern is not null and a is not null and b is not null")
    return x.select("pattern", "name", F.least("a", "b").alias("start1"), F.greatest("a", "b").alias("end1"))


def read_interpro(spark: SparkSession, paths: Paths, keep: Sequence[str] = ()) -> DataFrame:
    """Distinct domain annotations that have an entry; keep: databases."""
    # Columns of the tool's output, in order.
    kinds = "acc:s md5:s len:i db:s sig:s sig_desc:s start:i end:i score:d status:s date:s ipr:s ipr_desc:s go:s path:s"
    x = _lines(spark, paths).select(F.split("value", r"\t").alias("p")).select(*_fields(kinds, F.col("p"))).filter("ipr is not null")
    return (x.filter(F.col("db").isin(list(keep))) if keep else x).dropDuplicates()


def read_manifest(spark: SparkSession, paths: Paths) -> DataFrame:
    """Chunk manifests with a header; an error if columns are missing."""
    x = spark.read.option("sep", "\t").option("header", True).csv([paths] if isinstance(paths, str) else list(paths))
    # Columns of a manifest.
    need = ["chunk_id", "orig_id", "chunk_index", "chunks_total", "orig_aa_start", "orig_aa_end", "chunk_aa_len", "orig_aa_len"]
    missing = [c for c in need if c not in x.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return x.select("chunk_id", "orig_id", *(to_integer(F.col(c)).alias(c) for c in need[2:]))


def read_vectors(spark: SparkSession, paths: Paths) -> DataFrame:
    """(id, v) of headerless lines of an id and numbers, by tabs."""
    p = F.split("value", "\t")
    x = _lines(spark, paths).select(F.trim(F.get(p, F.lit(0))).alias("id"), F.transform(F.slice(p, 2, F.greatest(F.lit(0), F.size(p) - 1)), lambda t: t.try_cast("double")).alias("v"))
    return x.filter("id <> '' and size(v) > 0")


def read_record_objects(spark: SparkSession, paths: Paths, schema: str) -> DataFrame:
    """(key, record fields) of JSON objects of records; keys with a leading `_` are about the file and left out."""
    x = spark.read.text([paths] if isinstance(paths, str) else list(paths), wholetext=True)
    x = x.select(F.explode(F.from_json("value", f"map<string, struct<{schema}>>")).alias("key", "r"))
    return x.filter(~F.col("key").startswith("_")).select("key", "r.*")


def read_runs(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """Runs (run, n, seconds) and their samples (run, t, rss, cpu) of JSON reports, one a file."""
    schema = "meta struct<n: bigint>, result struct<seconds: double>, samples array<struct<t_rel_s: double, process: struct<rss_bytes: bigint, cpu_percent: double>>>"
    x = spark.read.schema(schema).option("multiLine", True).json([paths] if isinstance(paths, str) else list(paths)).withColumn("run", F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1))
    samples = x.select("run", F.explode("samples").alias("s")).select("run", F.col("s.t_rel_s").alias("t"), F.col("s.process.rss_bytes").alias("rss"), F.col("s.process.cpu_percent").alias("cpu"))
    return x.select("run", F.col("meta.n").alias("n"), F.col("result.seconds").alias("seconds")), samples


def read_training_log(spark: SparkSession, paths: Paths, need: Sequence[str] = ("epoch",)) -> DataFrame:
    """Rows of the array `log` of metrics files; an error if columns are missing."""
    x = spark.read.option("multiLine", True).json([paths] if isinstance(paths, str) else list(paths))
    if "log" not in x.columns:
        raise ValueError("no log")
    rows = x.select(F.explode("log").alias("r")).select("r.*")
    missing = [c for c in need if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return rows


def paired_inputs(spark: SparkSession, folder: str, kinds: dict[str, str]) -> DataFrame:
    """(stem, one path a kind) of files that come in sets; kinds: name -> file ending. Incomplete sets are left out."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    out = None
    for name, ending in kinds.items():
        one = files.filter(F.col("path").endswith(ending)).select(F.regexp_extract("path", r"([^/]+)" + re.escape(ending) + "$", 1).alias("stem"), F.col("path").alias(name))
        out = one if out is None else out.join(one, "stem")
    return out


def parse_targets(specs: str) -> list[tuple[str, str]]:
    """`ENTITY:CHAIN` items by commas; errors for others."""
    out = []
    for item in filter(None, (s.strip() for s in specs.split(","))):
        parts = item.split(":")
        if len(parts) != 2 or not all(parts):
            raise ValueError(f"not ENTITY:CHAIN: {item}")
        out.append((parts[0], parts[1]))
    return out


def parse_numbers(text: str, low: float, high: float) -> list[float]:
    """Numbers by commas, each within [low, high]."""
    out = [float(x) for x in text.split(",") if x.strip()]
    if not out or any(not low <= x <= high for x in out):
        raise ValueError(f"numbers from {low} to {high} expected: {text}")
    return out


def resolve_weights(local: str | None, named: str | None, environment: str = "SEQLOOM_WEIGHTS") -> str:
    """The file of weights: a local `.pt` or `.npz` first, then a name, then the environment."""
    choice = local or named or os.environ.get(environment)
    if not choice:
        raise ValueError("no weights given")
    if local and not (local.endswith((".pt", ".npz")) and os.path.exists(local)):
        raise ValueError(f"not a file of weights: {local}")
    return choice
