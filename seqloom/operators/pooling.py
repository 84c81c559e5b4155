"""Pooling of token vectors: mean, weighted, by span and by largest weights.

Two forms: expressions for vectors that lie in one row (ARRAY<ARRAY<FLOAT>>), and aggregates for long rows
(key, vector, weight), which are combined before the shuffle by (key, dimension).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import bound, total


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def weighted_pool(vectors: Column, weights: Column) -> Column:
    """sum(w v) / sum(w) of a row's vectors; the plain mean where the weights' sum is at most 1e-12 or not finite; null for no vectors."""

    def pooled(w: Column) -> Column:
        parts = F.zip_with(vectors, w, lambda v, x: F.transform(v, lambda e: e.cast("double") * x))
        zero = F.transform(F.element_at(vectors, 1), lambda e: F.lit(0.0))
        return bound(total(w), lambda t: F.transform(F.aggregate(parts, zero, _add), lambda e: e / t))

    w = F.transform(weights, lambda x: x.cast("double"))
    ones = F.transform(vectors, lambda v: F.lit(1.0))
    return F.when(F.size(vectors) > 0, bound(w, lambda x: F.when((total(x) > 1e-12) & (total(x) < float("inf")), pooled(x)).otherwise(pooled(ones))))


def mean_pool(vectors: Column) -> Column:
    return weighted_pool(vectors, F.transform(vectors, lambda v: F.lit(1.0)))


def top_positions(weights: Column, k: int) -> Column:
    """Positions from 0 of the k largest weights (at least one, at most all), equal ones in order of position."""
    pairs = F.transform(weights, lambda w, i: F.struct((-w).alias("w"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, max(1, k)), lambda p: p["i"])


def pick(values: Column, positions: Column) -> Column:
    return F.transform(positions, lambda i: F.get(values, i))


def panels(vectors: Column, weights: Column, s: Column, e: Column, k: int) -> Column:
    """STRUCT of the six pools: of all (mean, weighted), of the span s..e (both inside), of the k largest weights, and of the rest."""
    length = e - s + 1
    span_v, span_w = F.slice(vectors, s + 1, length), F.slice(weights, s + 1, length)
    top = top_positions(weights, k)
    rest = F.filter(vectors, lambda v, i: (i < s) | (i > e))
    return F.struct(
        mean_pool(vectors).alias("full_mean"),
        weighted_pool(vectors, weights).alias("full_attn_norm"),
        mean_pool(span_v).alias("span_mean"),
        weighted_pool(span_v, span_w).alias("span_attn_norm"),
        weighted_pool(pick(vectors, top), pick(weights, top)).alias("topk_attn_norm"),
        F.when(F.size(rest) > 0, mean_pool(rest)).alias("nonspan_mean"),
    )


def residue_vectors(vectors: Column, weights: Column, start: Column, s: Column, e: Column, scope: str) -> Column:
    """STRUCT<scope, local_pos, abs_pos, w, vectors> of the whole sequence or of the span s..e; null if vectors and weights don't match."""
    if scope not in ("full", "span"):
        raise ValueError(scope)
    first, n = (F.lit(0), F.size(vectors)) if scope == "full" else (s, e - s + 1)
    local = F.sequence(first, first + n - 1)
    return F.when(
        F.size(vectors) == F.size(weights),
        F.struct(F.lit(scope).alias("scope"), local.alias("local_pos"), F.transform(local, lambda i: i + start).alias("abs_pos"), F.slice(weights, first + 1, n).alias("w"), F.slice(vectors, first + 1, n).alias("vectors")),
    )


def pool_rows(df: DataFrame, keys: Sequence[str], vector: str, weight: Column | None = None, how: str = "mean", out: str = "pooled") -> DataFrame:
    """(keys, out): a pool over the rows of each key. how: `mean`, `sum`, `attn` (weighted sum) or `attn-norm` (weighted mean; uniform if the weights' sum isn't above 0)."""
    w = F.lit(1.0) if weight is None or how in ("mean", "sum") else weight.cast("double")
    long = df.select(*keys, w.alias("__w"), F.posexplode(vector).alias("__i", "__x"))
    x = F.col("__x").cast("double")
    weighted, plain = F.sum(F.col("__w") * x), F.avg(x)
    value = {"mean": plain, "sum": F.sum(x), "attn": weighted, "attn-norm": F.when(F.sum("__w") > 0, weighted / F.sum("__w")).otherwise(plain)}[how]
    dims = long.groupBy(*keys, "__i").agg(value.alias("__x"))
    return dims.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__x"))), lambda s: s["__x"]).alias(out))


def aggregate_attention(df: DataFrame, key: str, start: str, weights: str, length: str) -> DataFrame:
    """(key, profile): the weights of overlapping chunks added up by absolute position, 0 where there are none.

    length is the key's full length (the largest of its rows); positions beyond it are left out.
    """
    long = df.select(key, F.posexplode(weights).alias("__i", "__w"), F.col(start).alias("__s"))
    sums = long.groupBy(key, (F.col("__s") + F.col("__i")).alias("pos")).agg(F.sum(F.col("__w").cast("double")).alias("w"))
    frame = df.groupBy(key).agg(F.max(length).alias("__n")).select(key, F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("__n") - 1))).alias("pos"))
    whole = frame.join(sums, [key, "pos"], "left").select(key, "pos", F.coalesce("w", F.lit(0.0)).alias("w"))
    return whole.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"]).alias("profile"))


def ranked_within(df: DataFrame, keys: Sequence[str], weight: str, position: str, k: int) -> DataFrame:
    """Long form of top_positions: the rows with the k largest weights of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(weight), position)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= max(1, k)).drop("__n")
