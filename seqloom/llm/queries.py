"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame. Their SQL is in sql.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint, table
from .bpe import count_tokens, encode_texts
from .clusters import clusters, describe, leaves
from .cutoff import cutoffs
from .groupsplit import groups, splits
from .mixing import language, mix
from .neighbours import most_similar, pairs
from .pieces import pieces
from .subjects import subjects_of
from .sql import SQL  # noqa: F401


def _open_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "split_results").filter("mode = 'GLOBAL' and threshold is null")
    return rows.select("source", "metric", F.col("target_fpr").alias("fraction"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoffs(table(spark, sf_dir, "fold_scores"), _open_rows(spark, sf_dir))[0]


def p1_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoffs(table(spark, sf_dir, "fold_scores"), _open_rows(spark, sf_dir))[1]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).drop("chunks_total")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "fasta_records"), table(spark, sf_dir, "chunk_settings"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "label_table"), table(spark, sf_dir, "chunk_manifest"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its split."""
    return splits(checkpoint(p3_groups(spark, sf_dir)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that share their split with others, as they were split."""
    rows = checkpoint(p3_splits(spark, sf_dir))
    linked = rows.groupBy("group_id").count().filter("count > 1")
    return rows.join(linked, "group_id", "left_semi").select("row_id", "group_id")


def p3_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split: its target in rows, whether it is met within half a percent of all rows, and whether all its groups lie in it only."""
    rows = checkpoint(p3_splits(spark, sf_dir))
    torn = rows.groupBy("group_id").agg(F.min("split").alias("split"), F.countDistinct("split").alias("n")).filter("n > 1")
    goals = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    got = rows.groupBy("split").agg(F.count("*").alias("rows"))
    every = F.lit(rows.count())
    found = goals.join(got, "split", "left").join(torn.groupBy("split").agg(F.count("*").alias("torn")), "split", "left")
    target = F.round(F.col("share") * every).cast("bigint")
    near = F.abs(F.coalesce("rows", F.lit(0)) - F.col("share") * every) <= 0.005 * every + 1
    return found.select("split", target.alias("target"), near.alias("near"), (F.coalesce("torn", F.lit(0)) == 0).alias("whole"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups and share of rows of each split, and the rows by label."""
    grouped = checkpoint(p3_groups(spark, sf_dir))
    rows = splits(grouped).join(grouped.select("row_id", "label"), "row_id")
    labels = [F.count_if(F.col("label") == i).alias(f"label_{i}") for i in range(3)]
    found = rows.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("group_id").alias("groups"), *labels)
    return found.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))  # three rows


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "pooled_json"))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with its size, its compactness and its most typical entries."""
    entries = table(spark, sf_dir, "pooled_json")
    return describe(entries, checkpoint(clusters(entries)))


def p4_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaf of the bisecting tree with its size, its compactness and its most typical entries."""
    entries = table(spark, sf_dir, "pooled_json")
    return describe(entries, checkpoint(leaves(entries)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(most_similar(table(spark, sf_dir, "pooled_json")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", language(F.col("lang")).alias("lang"), "text")
    counted = checkpoint(count_tokens(docs, ["doc_id", "source", "lang"]))
    return mix(counted, table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixed(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: whether no document is used too often, and whether its tokens are its budget to less than its smallest document that is still open, or to a hundredth (all it may give if it is short)."""
    uses, report = _mixed(spark, sf_dir)
    most = uses.groupBy("source").agg(F.max("uses").alias("most"))
    wanted = F.when(F.col("short"), F.col("available") * F.col("max_repeats")).otherwise(F.col("budget"))
    near = F.abs(F.col("tokens") - wanted) <= F.when(F.col("short"), 0.5).otherwise(F.greatest(0.01 * wanted, F.coalesce(F.col("smallest_open").cast("double"), wanted)))
    rows = report.join(most, "source", "left")
    return rows.select("source", F.col("max_repeats").cast("bigint").alias("max_repeats"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), near.alias("on_target"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_examples"), table(spark, sf_dir, "subject_areas"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents and sentences; documents of several subjects count in each."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"))


QUERIES = {"p1_found": p1_found, "p1_cutoffs": p1_cutoffs, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_splits": p3_splits, "p3_balance": p3_balance, "p3_report": p3_report, "p4_found": p4_found, "p4_clusters": p4_clusters, "p4_leaves": p4_leaves, "p5_found": p5_found, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_report": p8_report, "p8_balance": p8_balance, "p9_found": p9_found, "p9_composition": p9_composition}
