"""Best rows and ranks per key. Ties end in the given order columns, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_nan(x: Column) -> Column:
    """A score for ranking: null and NaN are the worst."""
    return F.coalesce(F.nanvl(x, F.lit(float("-inf"))), F.lit(float("-inf")))


def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in `order`. Null keys are a key of their own; a key's rows are sorted, not collected."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def best_by(df: DataFrame, keys: Sequence[str], rank: Column, columns: Sequence[str]) -> DataFrame:
    """As best_rows for the greatest `rank` (a struct), as an aggregate that is combined before the shuffle: for hot keys."""
    whole = F.max_by(F.struct(*columns), rank).alias("__b")
    return df.groupBy(*keys).agg(whole).select(*keys, *(F.col(f"__b.{c}").alias(c) for c in columns))


def flag_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column], flag: str = "is_best") -> DataFrame:
    """Every row, with a flag on the best of its key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(flag, F.row_number().over(w) == 1)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks from 1 by value, equal values sharing their mean rank."""
    w = Window.partitionBy(*keys).orderBy(value)
    same = Window.partitionBy(*keys, value)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(same) - 1) / 2.0)


def mid_percentile(df: DataFrame, keys: Sequence[str], value: str, out: str = "pct") -> DataFrame:
    """(number below + half of the number equal, itself included) / number of the key."""
    w = Window.partitionBy(*keys)
    below = F.rank().over(w.orderBy(value)) - 1
    equal = F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn(out, (below + 0.5 * equal) / F.count("*").over(w))


def deduplicate_vectors(df: DataFrame, key: str, vector: str, score: str, order: Column, mode: str) -> DataFrame:
    """One row a key: `none` keeps the first, `maxP` the best score (NaN and null worst), `mean` the mean vector with the best row's other columns."""
    if mode == "none":
        return best_rows(df, [key], [order])
    best = best_rows(df, [key], [not_nan(F.col(score)).desc(), order])
    if mode == "maxP":
        return best
    if mode != "mean":
        raise ValueError(mode)
    long = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))
    return best.drop(vector).join(mean, key, "left")
