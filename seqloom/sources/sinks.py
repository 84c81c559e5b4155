"""Writers: each makes text rows inside the JVM and lets Spark write them, a file a partition."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed_text


#: Fixed value: the first line of a file of features.
VERSION = "##gff-version 3"


def fasta_rows(seq_id: Column, seq: Column, width: int = 60) -> Column:
    """A record as text, lines of `width` letters (0: one line); the last line has no end, as the sink adds it."""
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else seq
    return F.concat(F.lit(">"), seq_id, F.lit("\n"), F.coalesce(body, F.lit("")))


def write_fasta(df: DataFrame, path: str, seq_id: str = "seq_id", seq: str = "seq", width: int = 60, by: Sequence[str] = (), most_records: int = 0, mode: str = "errorifexists") -> None:
    """FASTA text; `by` gives a folder a value (folds, parts), most_records a limit for each file."""
    rows = df.select(fasta_rows(F.col(seq_id), F.col(seq), width).alias("value"), *by)
    writer = rows.write.mode(mode)
    if most_records:
        writer = writer.option("maxRecordsPerFile", most_records)
    (writer.partitionBy(*by) if by else writer).text(path)


def gff3_rows(df: DataFrame, least_p: float = 0.0, extra: Sequence[str] = (), source: str = "seqloom", feature: str = "RdRP_domain") -> DataFrame:
    """(value): features of base_id, start, end (1-based, both inside), P and the attributes ID, P and `extra`, for P of at least least_p."""
    attrs = F.concat_ws(";", F.concat(F.lit("ID="), F.col("base_id")), F.concat(F.lit("P="), fixed_text(F.col("P"), 6)), *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in extra))
    rows = df.filter(F.col("P") >= least_p)
    return rows.select(F.concat_ws("\t", "base_id", F.lit(source), F.lit(feature), F.col("start").cast("string"), F.col("end").cast("string"), fixed_text(F.col("P"), 6), F.lit("."), F.lit("."), attrs).alias("value"))


def full_gff3_rows(df: DataFrame, least_p: float = 0.0, source: str = "seqloom", feature: str = "RdRP_domain", temperature: float = 1.0, mass: float = 0.9, hpd: bool = True) -> DataFrame:
    """(value): features with all attributes in their fixed order.

    df: base_id, chunk_id, start, end, P, logit, calibrated_logit, sigma, length, entropy.
    """
    text = lambda c, digits: fixed_text(F.col(c).cast("double"), digits)
    # Names of the attributes, in their order.
    parts = {
        "ID": F.col("base_id"),
        "Name": F.lit("RdRP_catalytic_center"),
        "Chunk": F.col("chunk_id"),
        "P": text("P", 6),
        "Logit": text("logit", 6),
        "CalibratedLogit": text("calibrated_logit", 6),
        "Temperature": F.lit(f"{temperature:.6g}"),
        "sigma": text("sigma", 4),
        "len": F.col("length").cast("string"),
        "SpanSource": F.lit("HPD" if hpd else "kSigma"),
        "AttnMass": F.lit(f"{mass:.2f}"),
        "AttnEntropy": text("entropy", 6),
    }
    attrs = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v) for k, v in parts.items()))
    fields = ["base_id", F.lit(source), F.lit(feature), F.col("start").cast("string"), F.col("end").cast("string"), text("P", 6), F.lit("."), F.lit("."), attrs]
    return df.filter(F.col("P") >= least_p).select(F.concat_ws("\t", *fields).alias("value"))


def write_gff3(df: DataFrame, path: str, mode: str = "errorifexists", full: bool = False, **options) -> None:
    """Features in the order of the input, a file a partition, each beginning with the version line; one file with it for no features."""

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if batch.num_rows and not begun:
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array([VERSION])], ["value"])
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    rows = full_gff3_rows(df, **options) if full else gff3_rows(df, **options)
    if rows.isEmpty():
        df.sparkSession.createDataFrame([(VERSION,)], "value string").coalesce(1).write.mode(mode).text(path)
    else:
        rows.mapInArrow(headed, "value string").write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, meta: dict | None = None, mode: str = "errorifexists") -> None:
    """JSON lines; what is known of all rows goes into `_meta.json` beside them."""
    df.write.mode(mode).json(path)
    if meta is not None:
        spark = df.sparkSession
        text = json.dumps(meta, sort_keys=True)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "_meta"))


def json_object(df: DataFrame, key: str, meta: dict | None = None, most: int = 100_000) -> str:
    """All rows as one JSON object by key, for results of at most `most` rows (else an error; write_json has no limit); `_meta` first."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("j"), F.col(key).alias("k")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    rows.sort(key=lambda r: r.k)
    out = {"_meta": meta} if meta is not None else {}
    return json.dumps(out | {str(r.k): json.loads(r.j) for r in rows})


def write_csv(df: DataFrame, path: str, digits: dict[str, int] | None = None, sep: str = ",", mode: str = "errorifexists") -> None:
    """CSV with a header; columns in `digits` with fixed decimals, empty for null and NaN."""
    cols = [fixed_text(F.col(c).cast("double"), digits[c]).alias(c) if digits and c in digits else F.col(c) for c in df.columns]
    df.select(*cols).write.mode(mode).option("header", True).option("sep", sep).option("emptyValue", "").csv(path)


def write_matrix(df: DataFrame, path: str, key: str, vector: str, width: int, mode: str = "errorifexists") -> None:
    """A dense table: the key and a column a dimension, by tabs."""
    df.select(key, *(F.get(F.col(vector), F.lit(i)).alias(f"v{i}") for i in range(width))).write.mode(mode).option("header", True).option("sep", "\t").csv(path)


def write_edges(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Edges `src<TAB>dst<TAB>weight` with six decimals."""
    df.select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string"), fixed_text(F.col("weight"), 6)).alias("value")).write.mode(mode).text(path)


def write_labels(df: DataFrame, path: str, settings: dict, mode: str = "errorifexists") -> dict:
    """Parquet, with the counts by label, a hash of the contents that doesn't depend on the order, and the settings, in a `_meta` text beside it."""
    df.write.mode(mode).parquet(os.path.join(path, "rows"))
    back = df.sparkSession.read.parquet(os.path.join(path, "rows"))
    counts = {str(r["label"]): r["count"] for r in back.groupBy("label").count().collect()}
    total = back.agg(F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")).alias("h")).first().h
    meta = {"counts": counts, "hash": str(total or 0), "settings": settings}
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "_meta"))
    return meta


def write_clusters(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """`node<TAB>cluster` with a header."""
    df.select("node", "cluster").write.mode(mode).option("header", True).option("sep", "\t").csv(path)


def write_sparse_rows(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A symmetric sparse matrix as Parquet, a row a node: its neighbours in order and their weights. For graphs of bounded degree."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    cells = F.array_sort(F.collect_list(F.struct("dst", "weight")))
    rows = both.groupBy(F.col("src").alias("node")).agg(cells.alias("c"))
    rows.select("node", F.col("c.dst").alias("indices"), F.col("c.weight").alias("weights")).write.mode(mode).parquet(path)


#: Columns of tables that are written with fixed decimals: curves, operating points, chunk manifests and records.
LAYOUTS = {
    "curves": {"recall": 6, "precision": 6, "fpr": 6},
    "operating_points": {"target": 6, "threshold": 6, "fpr": 6},
    "manifest": {},
    "records": {"P": 6, "logit": 6, "calibrated_logit": 6},
}


def write_layout(df: DataFrame, path: str, layout: str, mode: str = "errorifexists") -> None:
    """One of the tables of LAYOUTS by tabs, with a header."""
    write_csv(df, path, {c: n for c, n in LAYOUTS[layout].items() if c in df.columns}, "\t", mode)
