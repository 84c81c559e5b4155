"""Items of token vectors as Parquet: a folder for each bucket of the key's hash, so that later runs only add files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import positions
from ..operators.joins import allowed

# Labels by number where a file doesn't say otherwise.
LABELS = {0: "N", 1: "U", 2: "P"}


def unique_keys(df: DataFrame, key: str, order: Sequence[str], out: str = "item") -> DataFrame:
    """df with a key that is unique: repeated ones get `__1`, `__2` and so on, in the given order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn(out, F.when(n == 0, F.col(key)).otherwise(F.concat(F.col(key), F.lit("__"), n.cast("string"))))


def write_items(df: DataFrame, path: str, key: str = "chunk_id", buckets: int = 64, mode: str = "append", compression: str = "zstd") -> None:
    """Items by bucket of the key; a folder holds one file for each run and bucket."""
    rows = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    rows.repartition("bucket").write.mode(mode).option("compression", compression).partitionBy("bucket").parquet(path)


def missing_items(todo: DataFrame, spark: SparkSession, path: str, key: str = "chunk_id") -> DataFrame:
    """The rows of todo whose key no item has yet; only the key's column is read."""
    return todo.join(spark.read.parquet(path).select(key), key, "left_anti")


def read_items(spark: SparkSession, path: str, ids: DataFrame | None = None, closed: bool = True, key: str = "chunk_id") -> DataFrame:
    """Items (key, tokens, L, orig_start, orig_len, ...): masked tokens left out, a position channel put behind each vector.

    ids: the keys that are wanted, pushed down to the scan where they are few. orig_start defaults to 0 and orig_len to
    the number of tokens. Columns: `emb` ARRAY<ARRAY<FLOAT>>, and `mask`, orig_aa_start and orig_aa_len, where there.
    """
    df = spark.read.parquet(path)
    if ids is not None:
        df = allowed(df, key, ids)
    kept = F.filter("emb", lambda v, i: F.coalesce(F.get(F.col("mask"), i), F.lit(True))) if "mask" in df.columns else F.col("emb")
    has = lambda c, other: F.coalesce(F.col(c), other) if c in df.columns else other
    df = df.withColumn("emb", kept).withColumn("L", F.size("emb"))
    tokens = F.zip_with("emb", positions(F.col("L"), closed), lambda v, p: F.concat(v.cast("array<double>"), F.array(p)))
    out = df.withColumn("tokens", tokens).withColumn("orig_start", has("orig_aa_start", F.lit(0))).withColumn("orig_len", has("orig_aa_len", F.col("L")))
    return out.drop("emb", "mask", "orig_aa_start", "orig_aa_len", "bucket")


def labelled_items(items: DataFrame, labels: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Items with their labels; items without a label are left out."""
    return items.join(labels, key)


def label_map(text: str | None) -> dict[int, str]:
    """Names of labels by number from a JSON object in either direction; the usual ones for what can't be read."""
    try:
        found = json.loads(text) if text else {}
    except ValueError:
        return dict(LABELS)
    out: dict[int, str] = {}
    for k, v in found.items() if isinstance(found, dict) else ():
        for number, name in ((k, v), (v, k)):
            try:
                out[int(number)] = str(name)
                break
            except (TypeError, ValueError):
                continue
    return out or dict(LABELS)


def label_name(label: Column, names: dict[int, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), label)


def vector_sets(sets: Sequence[DataFrame], key: str = "id", vector: str = "v") -> DataFrame:
    """The union of several sets of vectors with `source`, their number; an error if widths differ."""
    out = None
    for i, s in enumerate(sets):
        one = s.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.lit(i).alias("source"))
        out = one if out is None else out.unionByName(one)
    widths = [r.w for r in out.select(F.size("v").alias("w")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError(f"vectors of several widths: {sorted(widths)}")
    return out
