"""Nearest neighbours of a query set, mutual edges, bootstrap consensus and communities on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .sampling import ordinals

#: Queries that are sent to all rows at a time.
QUERY_BLOCK = 4096


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query, key, similarity, rank): the k rows of df most similar to each query (exact), itself left out, ties by key.

    The similarity is max(0, cosine) or 1 / (1 + distance), rounded to 6 decimals. Queries go to all rows in blocks of
    QUERY_BLOCK; every partition keeps its k best for each, so that k rows a query and partition are shuffled.
    Null vectors, such of another length than the first query's, and with non-finite numbers are left out; zero
    vectors have cosine 0.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(metric)
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<float>").alias("v"))
    asked = queries.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<float>").alias("v")).filter("key is not null and size(v) > 0")

    def read(keys: list, vectors: list, width: int | None) -> tuple[np.ndarray, np.ndarray]:
        good = [(i, v) for i, v in zip(keys, vectors) if i is not None and v is not None and (width is None or len(v) == width) and None not in v]
        x = np.array([v for _, v in good], np.float64).reshape(len(good), -1)
        ok = np.isfinite(x).all(1)
        return np.array([i for i, _ in good], np.int64)[ok], x[ok]

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)

    parts = []
    if asked.count() > QUERY_BLOCK:
        block = ordinals(asked, ["key"], "n").select("key", "v", F.floor(F.col("n") / QUERY_BLOCK).alias("b"))
    else:
        block = asked.withColumn("b", F.lit(0))
    block = checkpoint(block)
    for b in sorted(r.b for r in block.select("b").distinct().collect()):
        got = block.filter(F.col("b") == b).orderBy("key").collect()
        width = len(got[0].v)
        qk, qx = read([r.key for r in got], [r.v for r in got], width)
        if metric == "cosine":
            qx = unit(qx)

        def run(batches: Iterator[pa.RecordBatch], qk=qk, qx=qx, width=width) -> Iterator[pa.RecordBatch]:
            best: list[tuple[np.ndarray, ...]] = []
            for batch in batches:
                ks, x = read(batch.column("key").to_pylist(), batch.column("v").to_pylist(), width)
                if not len(ks) or not len(qk):
                    continue
                for i in range(0, len(qk), 512):
                    q = qx[i : i + 512]
                    if metric == "cosine":
                        s = np.maximum(0.0, q @ unit(x).T)
                    else:
                        d2 = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T
                        s = 1 / (1 + np.sqrt(np.maximum(0.0, d2)))
                    s = np.round(s, 6)
                    s[qk[i : i + 512, None] == ks[None]] = -1
                    m = min(k, s.shape[1])
                    cut = np.partition(s, s.shape[1] - m, axis=1)[:, -m]
                    r, c = np.nonzero((s >= cut[:, None]) & (s >= 0))
                    order = np.lexsort((ks[c], -s[r, c], r))
                    r, c = r[order], c[order]
                    nth = np.arange(len(r)) - np.searchsorted(r, r)
                    r, c = r[nth < k], c[nth < k]
                    best.append((qk[i + r], ks[c], s[r, c]))
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*best)], ["query", "key", "similarity"])

        parts.append(rows.mapInArrow(run, "query bigint, key bigint, similarity double"))
    if not parts:
        return rows.select(F.col("key").alias("query"), "key", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def undirected(directed: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """(src, dst, weight), src < dst: the greater weight of both directions."""
    return directed.groupBy(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).agg(F.max(weight).alias("weight")).filter("src < dst")


def mutual(directed: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """(src, dst, weight), src < dst: only edges that exist in both directions, with the mean weight."""
    pairs = directed.groupBy(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"))
    return pairs.agg(F.countDistinct(src).alias("__n"), F.avg(weight).alias("weight")).filter("__n = 2 and src < dst").drop("__n")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbours): sorted distinct neighbours, for graphs of bounded degree such as k nearest neighbours."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("o")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("o")))
    return both.groupBy("node").agg(F.array_sort(F.collect_set("o")).alias("neighbours"))


def communities(edges: DataFrame, keys: tuple[str, ...] = (), rounds: int = 8, weighted: bool = True) -> DataFrame:
    """(keys, node, label): label propagation, all nodes at once; each takes the label with the largest weight around it, its own counting half.

    Ties go to the smaller label. A deterministic stand-in for modularity clustering: partitions are comparable in
    kind, not label by label. Every round is two aggregates over the edges and a checkpoint.
    """
    w = F.col("weight") if weighted else F.lit(1.0)
    both = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("o"), w.cast("double").alias("w"))
    both = checkpoint(both.unionByName(both.select(*keys, F.col("o").alias("node"), F.col("node").alias("o"), "w")))
    own = both.groupBy(*keys, "node").agg((F.max("w") / 2).alias("w"))
    labels = checkpoint(own.select(*keys, "node", F.col("node").alias("label")))
    for _ in range(rounds):
        heard = both.join(labels.withColumnRenamed("node", "o"), [*keys, "o"]).select(*keys, "node", "label", "w")
        mine = labels.join(own, [*keys, "node"]).select(*keys, "node", "label", "w")
        votes = heard.unionByName(mine).groupBy(*keys, "node", "label").agg(F.round(F.sum("w"), 9).alias("w"))
        labels = checkpoint(votes.groupBy(*keys, "node").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label")))
    return labels


def bootstrap_consensus(edges: DataFrame, rounds: int, fraction: float, least: float, seed: int = 0) -> DataFrame:
    """(src, dst, cosampled, coassigned, freq): how often both ends of an edge share a community in subsamples of the nodes.

    Round b keeps a node by a hash of (seed + b, node); all rounds run as one graph with b as a key. Edges with freq
    of at least `least` are returned, freq being 0 where the ends were never drawn together.
    """
    drawn = edges.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    keep = lambda n: F.pmod(F.xxhash64(F.lit(seed) + F.col("b"), F.col(n)), F.lit(1_000_000)) < int(fraction * 1_000_000)
    drawn = checkpoint(drawn.filter(keep("src") & keep("dst")))
    labels = communities(drawn, ("b",), rounds=5)
    x = drawn.join(labels.select("b", F.col("node").alias("src"), F.col("label").alias("l1")), ["b", "src"]).join(labels.select("b", F.col("node").alias("dst"), F.col("label").alias("l2")), ["b", "dst"])
    counts = x.groupBy("src", "dst").agg(F.count("*").alias("cosampled"), F.count_if(F.col("l1") == F.col("l2")).alias("coassigned"))
    every = edges.select("src", "dst").join(counts, ["src", "dst"], "left").fillna(0, ["cosampled", "coassigned"])
    freq = F.when(F.col("cosampled") > 0, F.col("coassigned") / F.nullif(F.col("cosampled"), F.lit(0))).otherwise(0.0)
    return every.withColumn("freq", freq).filter(F.col("freq") >= least)


def labelled_support(labels: DataFrame, consensus: DataFrame, least_size: int) -> DataFrame:
    """(node, label, support): labels of clusters below least_size become null; support is the mean freq of a node's edges within its cluster."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("__n"))
    kept = labels.join(sizes, "label").select("node", F.when(F.col("__n") >= least_size, F.col("label")).alias("label"))
    both = consensus.select(F.col("src").alias("node"), F.col("dst").alias("o"), "freq").unionByName(consensus.select(F.col("dst").alias("node"), F.col("src").alias("o"), "freq"))
    inside = both.join(kept, "node").join(kept.select(F.col("node").alias("o"), F.col("label").alias("__l")), "o").filter("label = __l")
    return kept.join(inside.groupBy("node").agg(F.avg("freq").alias("support")), "node", "left")


def principal_components(df: DataFrame, key: str, vector: str, keep: float | int) -> DataFrame:
    """(key, v): centred vectors on the first principal axes: a number of them, or as many as explain a fraction of the variance; rescaled to length 1.

    Sums and products are added up by partition; the D x D matrix reaches the driver. The sign of an axis is such that
    its largest element is positive. Null vectors are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    x = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter(F.col(vector).isNotNull())

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, 0.0, 0.0
        for batch in batches:
            m = np.array(batch.column("v").to_pylist(), np.float64)
            if len(m):
                n, s, p = n + len(m), s + m.sum(0), p + m.T @ m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.asarray(s).tolist()]), pa.array([np.asarray(p).ravel().tolist()])], ["n", "s", "p"])

    parts = checkpoint(x.select("v").mapInArrow(moments, "n bigint, s array<double>, p array<double>"))  # a row a partition
    add = lambda c: F.posexplode(c).alias("i", "x")
    sums = {c: [r.x for r in parts.select(add(c)).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()] for c in ("s", "p")}
    n = parts.agg(F.sum("n")).first()[0] or 0
    if n < 2:
        return x.limit(0).withColumnRenamed("key", key)
    mean = np.array(sums["s"]) / n
    cov = np.array(sums["p"]).reshape(len(mean), -1) / n - np.outer(mean, mean)
    value, axes = np.linalg.eigh(cov)
    value, axes = value[::-1], axes[:, ::-1]
    many = int(keep) if keep >= 1 else int(np.searchsorted(np.cumsum(value) / max(value.sum(), 1e-300), keep) + 1)
    axes = axes[:, :many] * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])[:many]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = (np.array(batch.column("v").to_pylist(), np.float64).reshape(batch.num_rows, -1) - mean) @ axes
            y /= np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(y.tolist(), pa.list_(pa.float64()))], ["key", "v"])

    return x.mapInArrow(project, f"key {kind}, v array<double>").withColumnRenamed("key", key)
