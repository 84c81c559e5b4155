"""Grouped statistics as single-pass aggregates; windows only over already aggregated rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import average_ranks


def known(x: Column) -> Column:
    """NaN as null, so that means leave it out."""
    return F.when(~F.isnan(x.cast("double")), x)


def sem(x: Column) -> Column:
    """Standard error of the mean; null for fewer than two values."""
    n = F.count(known(x))
    return F.when(n > 1, F.stddev_samp(known(x)) / F.sqrt(n))


def dose_summary(df: DataFrame, keys: Sequence[str], value: str, positive: Column) -> DataFrame:
    """(keys, n, mean, sd, sem, positive): rows, mean and spread of the known values, and the fraction of these that is positive. Null keys are left out."""
    x = df
    for k in keys:
        x = x.filter(F.col(k).isNotNull())
    v = F.col(value)
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(known(v)).alias("mean"), F.stddev_samp(known(v)).alias("sd"), sem(v).alias("sem"), F.avg(F.when(known(v).isNotNull(), positive.cast("double"))).alias("positive"))


def size_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, mean, sd, cv, least, median, most): cv in percent, null for a mean of 0."""
    v = known(F.col(value))
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), (100 * F.stddev_samp(v) / F.nullif(F.avg(v), F.lit(0.0))).alias("cv"), F.min(v).alias("least"), F.median(v).alias("median"), F.max(v).alias("most")
    )


def linear_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, slope, intercept, r2) of y by x, least squares."""
    args = (F.col(y).cast("double"), F.col(x).cast("double"))
    return df.groupBy(*keys).agg(F.regr_slope(*args).alias("slope"), F.regr_intercept(*args).alias("intercept"), F.regr_r2(*args).alias("r2"))


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "r") -> DataFrame:
    """(keys, out): null for fewer than two rows or a constant column."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.filter(a.isNotNull() & b.isNotNull())
    spread = F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0.0))
    return both.groupBy(*keys).agg((F.covar_pop(a, b) / spread).alias(out))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "rho") -> DataFrame:
    """Pearson of the average ranks."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both, keys, x, "__rx"), keys, y, "__ry")
    return pearson(ranked, keys, "__rx", "__ry", out)


def time_bins(df: DataFrame, keys: Sequence[str], t: str, value: str, width: float) -> DataFrame:
    """(keys, bin, mean) with t rounded to the nearest multiple of width, halves to even."""
    bin_ = (F.bround(F.col(t) / width) * width).alias("bin")
    return df.groupBy(*keys, bin_).agg(F.avg(known(F.col(value))).alias("mean"))


def random_hit(n: int, w: int, k: int) -> float:
    """1 - C(n - w, k) / C(n, k): the chance that k random positions of n meet a window of w."""
    if k <= 0 or w <= 0:
        return 0.0
    if k > n - w:
        return 1.0
    return 1 - math.exp(sum(math.log((n - w - i) / (n - i)) for i in range(k)))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def wilcoxon(df: DataFrame, keys: Sequence[str], difference: str) -> DataFrame:
    """(keys, n, w, z): signed ranks of the differences other than 0, with average ranks and the normal approximation."""
    x = df.filter((F.col(difference) != 0) & ~F.isnan(difference)).withColumn("__a", F.abs(difference))
    ranked = average_ranks(x, keys, "__a", "__r")
    n = F.count("*")
    w = F.sum(F.when(F.col(difference) > 0, F.col("__r")).otherwise(0.0))
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)
    return ranked.groupBy(*keys).agg(n.alias("n"), w.alias("w"), ((w - n * (n + 1) / 4.0) / spread).alias("z"))


#: Models of throughput by size: the function and its start from the data.
SATURATION = {
    "hyperbolic": (lambda x, a, b: a * x / (b + x), lambda x, y: (y.max() * 1.2, np.median(x))),
    "exponential": (lambda x, a, b: a * (1 - np.exp(-x / b)), lambda x, y: (y.max() * 1.1, np.median(x))),
}


def _gauss_newton(f, x: np.ndarray, y: np.ndarray, start: tuple[float, float]) -> np.ndarray:
    p = np.array(start, float)
    cost, damp = ((f(x, *p) - y) ** 2).sum(), 1e-2
    for _ in range(200):
        h = np.maximum(np.abs(p), 1e-6) * 1e-6
        j = np.stack([(f(x, *(p + np.eye(2)[i] * h[i])) - f(x, *p)) / h[i] for i in range(2)], 1)
        step = np.linalg.lstsq(j.T @ j + damp * np.diag(np.diag(j.T @ j) + 1e-12), j.T @ (y - f(x, *p)), rcond=None)[0]
        new = p + step
        value = ((f(x, *new) - y) ** 2).sum()
        if np.isfinite(value) and value < cost and (new > 0).all():
            done = cost - value < 1e-14 * max(cost, 1e-300)
            p, cost, damp = new, value, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p


def saturation_fits(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, model, a, b, r2, aic, bic, best): damped Gauss-Newton fits of both models to each key's points; keys with fewer than 3 points have no row.

    The points are means by size, so a key has as many as there are sizes.
    """

    def run(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        xs, ys = frame["x"].to_numpy(float), frame["y"].to_numpy(float)
        rows = []
        if len(xs) >= 3 and ys.max() > 0:
            for name, (f, start) in SATURATION.items():
                p = _gauss_newton(f, xs, ys, start(xs, ys))
                rss, n = max(float(((f(xs, *p) - ys) ** 2).sum()), 1e-300), len(xs)
                tss = float(((ys - ys.mean()) ** 2).sum())
                rows.append((k[0], name, *map(float, p), 1 - rss / tss if tss > 0 else math.nan, n * math.log(rss / n) + 4, n * math.log(rss / n) + 2 * math.log(n)))
        out = pd.DataFrame(rows, columns=["key", "model", "a", "b", "r2", "aic", "bic"])
        return out.assign(best=out["aic"] == out["aic"].min())

    means = df.groupBy(F.col(key).alias("key"), F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("y")).filter("x is not null and y is not null and x > 0")
    kind = df.schema[key].dataType.simpleString()
    return means.groupBy("key").applyInPandas(run, f"key {kind}, model string, a double, b double, r2 double, aic double, bic double, best boolean").withColumnRenamed("key", key)


def cluster_quality(df: DataFrame, vector: str, label: str, most_clusters: int = 10_000) -> DataFrame:
    """(n, clusters, davies_bouldin, calinski_harabasz) of labelled vectors, one row; nulls for fewer than two clusters.

    Sums by (cluster, dimension) are combined before the shuffle; only a row a cluster reaches the driver, at most
    `most_clusters` (else an error), as every centre is compared with each other.
    """
    x = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("c"), F.col(vector).cast("array<double>").alias("x"))
    dims = x.select("c", F.posexplode("x").alias("i", "x")).groupBy("c", "i").agg(F.avg("x").alias("m"))
    vec = dims.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda q: q["m"]).alias("v"))
    d2 = F.aggregate(F.zip_with("x", "v", lambda p, q: (p - q) ** 2), F.lit(0.0), lambda t, q: t + q)
    each = x.join(vec, "c").withColumn("d2", d2).groupBy("c").agg(F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("within"), F.count("*").alias("n"))
    rows = each.join(vec, "c").orderBy("c").limit(most_clusters + 1).collect()
    if len(rows) > most_clusters:
        raise ValueError(f"more than {most_clusters} clusters")
    k, n = len(rows), sum(r.n for r in rows)
    db = ch = None
    if k > 1:
        v, s, w = np.array([r.v for r in rows]), np.array([r.s for r in rows]), np.array([r.n for r in rows], float)
        far = np.sqrt(np.maximum(0, ((v[:, None] - v[None]) ** 2).sum(2)))
        np.fill_diagonal(far, np.inf)
        db = float(((s[:, None] + s[None]) / far).max(1).mean())
        grand = (v * w[:, None]).sum(0) / n
        within = sum(r.within for r in rows)
        ch = float((w * ((v - grand) ** 2).sum(1)).sum() / (k - 1) / (within / (n - k))) if within and n > k else None
    return df.sparkSession.createDataFrame([(n, k, db, ch)], "n bigint, clusters bigint, davies_bouldin double, calinski_harabasz double")


def silhouette(df: DataFrame, vector: str, label: str, most_clusters: int = 10_000) -> DataFrame:
    """(n, silhouette): the mean silhouette of labelled vectors by squared Euclidean distances, one row; null for fewer than two clusters.

    The mean squared distance of a vector to a cluster follows from the cluster's centre and its mean squared length,
    so that no pairs of vectors are made. At most `most_clusters` centres (else an error) meet each vector. A vector
    that is alone in its cluster has 0.
    """
    x = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("c"), F.col(vector).cast("array<double>").alias("x"))
    x = x.withColumn("q", F.aggregate("x", F.lit(0.0), lambda t, p: t + p * p))
    dims = x.select("c", F.posexplode("x").alias("i", "v")).groupBy("c", "i").agg(F.avg("v").alias("m"))
    centres = dims.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("m"))
    centres = centres.join(x.groupBy("c").agg(F.count("*").alias("n"), F.avg("q").alias("s")), "c")
    rows = centres.orderBy("c").limit(most_clusters + 1).collect()
    if len(rows) > most_clusters:
        raise ValueError(f"more than {most_clusters} clusters")
    if len(rows) < 2:
        return x.agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("silhouette"))
    number = {r.c: i for i, r in enumerate(rows)}
    m, n, s = np.array([r.m for r in rows]), np.array([r.n for r in rows], float), np.array([r.s for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own = np.array([number[c] for c in batch.column("c").to_pylist()])
            for i in range(0, len(v), 1000):
                x_, o = v[i : i + 1000], own[i : i + 1000]
                d = np.maximum(0.0, (x_ * x_).sum(1)[:, None] - 2 * x_ @ m.T + s[None])
                at = np.arange(len(o))
                a = d[at, o] * n[o] / np.maximum(n[o] - 1, 1)
                d[at, o] = np.inf
                b = d.min(1)
                high = np.maximum(a, b)
                total += float(np.where((n[o] == 1) | (high == 0), 0.0, (b - a) / np.where(high == 0, 1.0, high)).sum())
                count += len(o)
        yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([total])], ["n", "s"])

    parts = x.select("c", "x").mapInArrow(run, "n bigint, s double")
    return parts.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("silhouette"))


def motif_summary(df: DataFrame, keys: Sequence[str], percentile: str, distance: str) -> DataFrame:
    """(keys, n, mean_pct, median_pct, mean_distance, median_distance) of occurrences; nulls are left out of each."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(percentile).alias("mean_pct"), F.median(percentile).alias("median_pct"), F.avg(distance).alias("mean_distance"), F.median(distance).alias("median_distance")
    )
