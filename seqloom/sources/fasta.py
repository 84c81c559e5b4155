"""FASTA files as rows. Records are cut at line starts with `>` by the text source, so that large files are split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import printable, sanitised
from ..operators.joins import allowed
from ..operators.sampling import ordinals


def _begin_with_headers(spark: SparkSession, paths: str | Sequence[str]) -> None:
    """An error if the first line of a file that isn't blank is no header; the lines at a file's beginning are looked at."""
    lines = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"), "value").filter("b = 0 and trim(value) <> ''")
    bad = lines.groupBy("path").agg(F.min_by("value", "n").alias("first")).filter(~F.ltrim("first").startswith(">")).select("path").limit(1).collect()
    if bad:
        raise ValueError(f"sequence before a header in {bad[0].path}")


def read_fasta(spark: SparkSession, paths: str | Sequence[str], empty: str = "keep", numbered: bool = False, strict: bool = False, clean: str | None = None) -> DataFrame:
    """(path, ord, seq_id, header, seq) of FASTA files, also gzipped ones (which aren't split).

    Lines are stripped and joined, blank ones skipped. seq_id is the first word of the header, `unnamed` for an empty
    header. Records without sequence have an empty seq, or are dropped with empty="drop". ord grows along a file; with
    numbered it counts from 0 within each file, at the price of a range shuffle. Text before the first header is taken
    as a header line, or is an error with strict; Windows line ends are understood. clean: `printable` (upper case,
    printable, no stop marks) or `sanitised` (allowed residues, X for others).
    """
    if clean not in (None, "printable", "sanitised"):
        raise ValueError(clean)
    if empty not in ("keep", "drop"):
        raise ValueError(empty)
    if strict:
        _begin_with_headers(spark, paths)
    raw = spark.read.option("lineSep", "\n>").text([paths] if isinstance(paths, str) else list(paths))
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", r"^\s*>", "").alias("t"))
    rows = rows.filter(F.trim(F.regexp_replace("t", r"\s+", " ")) != "")
    header = F.btrim(F.substring_index("t", "\n", 1), F.lit(" \t\r"))
    body = F.when(F.instr("t", "\n") > 0, F.substr(F.col("t"), F.instr("t", "\n") + 1)).otherwise("")
    seq = F.btrim(F.regexp_replace(body, r"[ \t\r]*\n[ \t\r]*", ""), F.lit(" \t\r\n"))
    out = rows.select("path", "__b", "ord", F.coalesce(F.nullif(F.regexp_extract(header, r"^(\S*)", 1), F.lit("")), F.lit("unnamed")).alias("seq_id"), header.alias("header"), seq.alias("seq"))
    if clean is not None:
        out = out.withColumn("seq", printable(F.col("seq")) if clean == "printable" else sanitised(F.col("seq")))
    if empty == "drop":
        out = out.filter("seq <> ''")
    if numbered:
        n = ordinals(out, ["path", "__b", "ord"], "__n")
        first = n.groupBy("path").agg(F.min("__n").alias("__f"))
        out = n.join(first, "path").withColumn("ord", F.col("__n") - F.col("__f"))
    return out.select("path", "ord", "seq_id", "header", "seq")


def count_records(spark: SparkSession, paths: str | Sequence[str]) -> int:
    """Number of header lines."""
    return spark.read.text([paths] if isinstance(paths, str) else list(paths)).filter(F.col("value").startswith(">")).count()


def lengths(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(seq_id, length); an error if there are no records."""
    rows = read_fasta(spark, paths)
    if rows.isEmpty():
        raise ValueError(f"no records in {paths}")
    return rows.select("seq_id", F.length("seq").alias("length"))


def fetch(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records with the ids in the first column of ids: what an index of files is for, as a filter or a semi-join."""
    return allowed(records, "seq_id", ids)
