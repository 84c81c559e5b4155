"""Curves, areas and operating thresholds over scores, computed from counts per distinct score.

Rows are first counted by (group, score), which is combined before the shuffle, and running sums go over these counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def _running(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with, for each column in sums, its running sum along `order` within the keys, and its sum over all of the key.

    Without keys all rows are one order: they are range partitioned, and what the partitions before hold is added to
    the sums within each, so that no task has them all.
    """
    if keys:
        along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        return rows.select("*", *(F.sum(c).over(along).alias(so_far) for c, (so_far, _) in sums.items()), *(F.sum(c).over(whole).alias(in_all) for c, (_, in_all) in sums.items()))
    parts = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    held = parts.groupBy("__p").agg(*(F.sum(c).alias(c) for c in sums))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    ahead = held.select("__p", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in sums), *(F.sum(c).over(Window.partitionBy()).alias(in_all) for c, (_, in_all) in sums.items()))
    along = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(ahead), "__p")
    return out.select(*rows.columns, *((F.sum(c).over(along) + F.col(f"__{c}")).alias(so_far) for c, (so_far, _) in sums.items()), *(in_all for _, in_all in sums.values()))


def score_counts(df: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """(keys, score, tp, n, tps, ns, pos, total): rows and positives at each score, so far from the best on, and in all.

    Null and NaN scores are left out, null labels are negative.
    """
    x = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    counts = x.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count_if(positive).alias("tp"), F.count("*").alias("n"))
    return _running(counts, keys, [F.desc("score")], {"tp": ("tps", "pos"), "n": ("ns", "total")})


def _grouped(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(value) if keys else rows.agg(value)


def average_precision(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ap): sum of precision times gained recall, equal scores as one step; 0 without positives."""
    step = F.when(F.col("pos") > 0, (F.col("tps") / F.col("ns")) * (F.col("tp") / F.col("pos"))).otherwise(0.0)
    return _grouped(counts, keys, F.sum(step).alias("ap"))


def curves(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, score, recall, precision, fpr): a point for each distinct score; null rates where there are no positives or negatives."""
    return counts.select(
        *keys,
        "score",
        (F.col("tps") / F.nullif(F.col("pos"), F.lit(0))).alias("recall"),
        (F.col("tps") / F.col("ns")).alias("precision"),
        ((F.col("ns") - F.col("tps")) / F.nullif(F.col("total") - F.col("pos"), F.lit(0))).alias("fpr"),
    )


def row_curves(df: DataFrame, keys: Sequence[str], score: str, positive: Column, tie: str) -> DataFrame:
    """(keys, n, recall, precision, fpr): a point for each row, ties in the order of `tie`."""
    x = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    x = x.select(*keys, F.col(score).alias("__score"), F.col(tie).alias("__tie"), F.when(positive, 1).otherwise(0).alias("__hit"), F.lit(1).alias("__one"))
    x = _running(x, keys, [F.desc("__score"), F.asc("__tie")], {"__hit": ("tps", "pos"), "__one": ("n", "total")})
    return x.select(
        *keys, F.col("n").cast("bigint").alias("n"), (F.col("tps") / F.nullif(F.col("pos"), F.lit(0))).alias("recall"), (F.col("tps") / F.col("n")).alias("precision"), ((F.col("n") - F.col("tps")) / F.nullif(F.col("total") - F.col("pos"), F.lit(0))).alias("fpr")
    )


def roc_auc(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, auc): the trapezoids under the curve from (0, 0) on, ties as one step; null without positives or negatives."""
    fp, neg = F.col("n") - F.col("tp"), F.col("total") - F.col("pos")
    area = fp * (F.col("tps") - F.col("tp") / 2.0)
    return _grouped(counts, keys, (F.sum(area) / F.nullif(F.max(neg) * F.max("pos"), F.lit(0))).alias("auc"))


def recall_at_precision(counts: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """(keys, recall): the largest recall with a precision of at least `least`; 0 if there is none."""
    good = F.when((F.col("tps") / F.col("ns") >= least) & (F.col("pos") > 0), F.col("tps") / F.col("pos"))
    return _grouped(counts, keys, F.coalesce(F.max(good), F.lit(0.0)).alias("recall"))


def threshold_fpr(scores: DataFrame, sizes: DataFrame, keys: Sequence[str], value: str, low_is_good: Column) -> DataFrame:
    """(keys, threshold, passed, fpr): for each distinct value how many ids are at least as good, over all ids of the key.

    scores: (keys, value), one row an id; sizes: (keys, n) of all ids, scored or not. Non-finite values are left out.
    """
    v = F.col(value)
    x = scores.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    counts = x.groupBy(*keys, v.alias("threshold")).agg(F.count("*").alias("c"), F.first(low_is_good).alias("__low"))
    k = F.when(F.col("__low"), F.col("threshold")).otherwise(-F.col("threshold"))
    run = Window.partitionBy(*keys).orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
    passed = counts.select(*keys, "threshold", F.sum("c").over(run).alias("passed"))
    return passed.join(sizes, list(keys)).select(*keys, "threshold", "passed", (F.col("passed") / F.nullif(F.col("n"), F.lit(0))).alias("fpr"))


def _next_after(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in batches:
        yield v.map(lambda x: x if x is None or math.isnan(x) else math.nextafter(x, math.inf))


def beyond(value: Column, low_is_good: Column) -> Column:
    """The next double that is stricter than value: above it for scores, below it for e-values (not below 0)."""
    up = F.pandas_udf(_next_after, "double")
    return F.when(low_is_good, F.greatest(F.lit(0.0), -up(-value))).otherwise(up(value))


def operating_points(curve: DataFrame, keys: Sequence[str], targets: DataFrame, low_is_good: Column) -> DataFrame:
    """(keys, target, threshold, fpr, source): the most lenient threshold with fpr at most the target.

    source is `data` where a distinct value does, else `boundary`: the threshold is then just beyond the best
    value, with fpr 0. targets: one column, target. A target of 0 or less is always a boundary.
    """
    x = curve.withColumn("__low", low_is_good).withColumn("target", F.explode(F.array([F.lit(float(r[0])) for r in targets.collect()])))  # a list of settings
    ok = (F.col("fpr") <= F.col("target")) & (F.col("target") > 0)
    k = F.when(F.col("__low"), F.col("threshold")).otherwise(-F.col("threshold"))
    best = x.groupBy(*keys, "target").agg(F.max_by("threshold", F.when(ok, k)).alias("t"), F.max(F.when(ok, F.col("fpr"))).alias("f"), F.min_by("threshold", k).alias("top"), F.first("__low").alias("__low"))
    return best.select(*keys, "target", F.coalesce("t", beyond(F.col("top"), F.col("__low"))).alias("threshold"), F.coalesce("f", F.lit(0.0)).alias("fpr"), F.when(F.col("t").isNotNull(), "data").otherwise("boundary").alias("source"))


def calibrate_temperature(df: DataFrame, logit: str, positive: Column, rounds: int = 8, points: int = 9, low: float = 0.1, high: float = 10.0) -> float:
    """The temperature in [low, high] that minimises the mean cross entropy of logit / T; 1 without rows.

    The loss has one minimum over log T, so each round looks at `points` places between the ends, in one aggregate,
    and keeps the neighbourhood of the best.
    """
    x = df.filter(F.col(logit).isNotNull() & ~F.isnan(logit)).select(F.col(logit).alias("z"), positive.cast("double").alias("y"))
    counts = checkpoint(x.groupBy("z").agg(F.sum("y").alias("y"), F.count("*").alias("n")))

    def loss(t: float) -> Column:
        z = F.col("z") / t
        return F.sum(F.col("n") * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - F.col("y") * z)

    a, b = math.log(low), math.log(high)
    for _ in range(rounds):
        step = (b - a) / (points - 1)
        places = [a + i * step for i in range(points)]
        row = counts.agg(*(loss(math.exp(p)).alias(f"l{i}") for i, p in enumerate(places))).first()
        if row[0] is None:
            return 1.0
        best = min(range(points), key=lambda i: row[i])
        a, b = places[max(0, best - 1)], places[min(points - 1, best + 1)]
    return math.exp((a + b) / 2)


def span_summary(df: DataFrame, keys: Sequence[str], iou: str, least: float = 0.5) -> DataFrame:
    """(keys, n, mean_iou, iou_share): the mean IoU of predicted and true spans, and the share with at least `least`."""
    rows = df.filter(F.col(iou).isNotNull())
    each = [F.count("*").alias("n"), F.avg(iou).alias("mean_iou"), F.avg((F.col(iou) >= least).cast("double")).alias("iou_share")]
    return rows.groupBy(*keys).agg(*each) if keys else rows.agg(*each)
