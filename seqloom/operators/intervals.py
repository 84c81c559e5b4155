"""Interval algebra over DataFrames: union, intersection, IoU, coverage. Conventions are explicit.

Intervals are rows (keys..., s, e). `touch` is how far beyond its end an interval still reaches the next start:
0 for half-open intervals, 1 for closed ones of whole numbers; larger values close gaps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(df: DataFrame, keys: Sequence[str], s: str = "s", e: str = "e", touch: int = 0) -> DataFrame:
    """(keys, s, e): the union of each key's intervals as disjoint ones. Null ends are left out; the ends must be in order."""
    rows = df.select(*keys, F.col(s).alias("s"), F.col(e).alias("e")).filter("s is not null and e is not null and s <= e")
    order = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.when(before.isNull() | (F.col("s") > before + touch), 1).otherwise(0))
    runs = marked.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "__run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("__run")


def union_length(df: DataFrame, keys: Sequence[str], s: str = "s", e: str = "e", touch: int = 0) -> DataFrame:
    """(keys, length): positions covered, those of several intervals once; `touch` 1 counts closed intervals."""
    return merge(df, keys, s, e, touch).groupBy(*keys).agg(F.sum(F.col("e") - F.col("s") + touch).alias("length"))


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str], touch: int = 0, bucket: int = 4096) -> DataFrame:
    """(keys, s, e): positions that intervals of both sets cover, as disjoint intervals.

    The sides are merged first. They meet by key and block of `bucket` positions, so that a key with very many
    intervals is spread and only intervals of one block are compared.
    """

    def blocks(df: DataFrame, tag: str) -> DataFrame:
        m = merge(df, keys, touch=touch)
        first, last = F.floor(F.col("s") / bucket), F.floor((F.col("e") - 1 + touch) / bucket)
        return m.withColumn("__block", F.explode(F.sequence(first, F.greatest(first, last)))).withColumnsRenamed({"s": f"{tag}s", "e": f"{tag}e"})

    x = blocks(a, "x").join(blocks(b, "y"), [*keys, "__block"])
    low, high = F.greatest("xs", "ys", F.col("__block") * bucket), F.least("xe", "ye", (F.col("__block") + 1) * bucket - touch)
    cut = x.select(*keys, low.alias("s"), high.alias("e")).filter(F.col("s") < F.col("e") + touch)
    return merge(cut, keys, touch=touch)


def set_iou(a: DataFrame, b: DataFrame, keys: Sequence[str], universe: DataFrame, touch: int = 1) -> DataFrame:
    """(keys, iou) for each row of universe (keys): 1 where both sets are empty, 0 where one is."""
    la, lb = (union_length(x, keys, touch=touch).withColumnRenamed("length", n) for x, n in ((a, "la"), (b, "lb")))
    both = intersection(a, b, keys, touch).groupBy(*keys).agg(F.sum(F.col("e") - F.col("s") + touch).alias("li"))
    rows = universe.select(*keys).distinct()
    for side in (la, lb, both):
        rows = rows.join(side, list(keys), "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    union = n("la") + n("lb") - n("li")
    return rows.select(*keys, F.when(union == 0, 1.0).otherwise(n("li") / F.nullif(union, F.lit(0))).alias("iou"))


def coverage_summary(df: DataFrame, key: str, model: str, length: str, s: str = "s", e: str = "e", most: int = 8) -> DataFrame:
    """(key, summary): `model:coverage` of the best covering models, by coverage and name, joined with commas.

    Coverage is the union length over the largest known length of the key and may exceed 1, as ends aren't clipped.
    """
    lengths = df.groupBy(key).agg(F.max(length).alias("__len"))
    each = union_length(df, [key, model], s, e).join(lengths, key).filter(F.col("__len") > 0)
    each = each.select(key, F.struct((-F.round(F.col("length") / F.col("__len"), 4)).alias("c"), F.col(model).alias("m")).alias("x"))
    rank = Window.partitionBy(key).orderBy("x.c", "x.m")
    top = each.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= most)
    parts = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(x["m"], F.lit(":"), F.format_string("%.4f", -x["c"])))
    return top.groupBy(key).agg(F.array_join(parts, ",").alias("summary"))


class _Lanes:
    """Last ends of lanes in a tree of minima, so that the first free lane is found in steps of the depth."""

    def __init__(self):
        self.used, self.size, self.least = 0, 1, [math.inf, math.inf]

    def take(self, start: float, end: float) -> int:
        """The first lane whose last end is before start, else a new one; it ends at end from now on."""
        least = self.least
        if least[1] < start:
            at = 1
            while at < self.size:
                at *= 2
                if not least[at] < start:
                    at += 1
        else:
            if self.used == self.size:
                least = self._grow()
            at = self.size + self.used
            self.used += 1
        lane = at - self.size
        least[at] = end if end == end else math.inf  # nothing begins after NaN
        while at > 1:
            at //= 2
            least[at] = min(least[2 * at], least[2 * at + 1])
        return lane

    def _grow(self) -> list[float]:
        leaves = self.least[self.size :] + [math.inf] * self.size
        self.size *= 2
        self.least = [math.inf] * self.size + leaves
        for at in range(self.size - 1, 0, -1):
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])
        return self.least


def pack_lanes(df: DataFrame, key: str, s: str = "s", e: str = "e", order: str = "ord") -> DataFrame:
    """(key, order, s, e, lane): each interval, in order, in the first lane whose last end is before its start.

    Order-dependent, so rows pass sorted through one Python state a key; only the lanes' ends are held.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        present, free = object(), _Lanes()
        for batch in batches:
            lanes = []
            for k, start, end in zip(batch[key].tolist(), batch[s].tolist(), batch[e].tolist()):
                if k != present:
                    present, free = k, _Lanes()
                lanes.append(free.take(start, end))
            yield batch.assign(lane=lanes)

    rows = df.select(key, order, s, e).filter(F.col(s).isNotNull() & F.col(e).isNotNull() & F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, order)
    return rows.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, order, s, e)), "lane bigint"]))
