"""Running, rolling and positional operators over ordered rows, and cutting of sequences into windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, radius: int, how: str, out: str) -> DataFrame:
    """`max` or `mean` over the rows within radius on both sides, fewer at the edges; `mean_edges` repeats the edge rows instead."""
    w = Window.partitionBy(*keys).orderBy(*order)
    frame = w.rowsBetween(-radius, radius)
    v = F.col(value)
    if how == "max":
        return df.withColumn(out, F.max(v).over(frame))
    if how == "mean":
        return df.withColumn(out, F.avg(v).over(frame))
    if how != "mean_edges":
        raise ValueError(how)
    n, i = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(w)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lacking_left, lacking_right = F.greatest(F.lit(0), radius + 1 - i), F.greatest(F.lit(0), i + radius - n)
    total = F.sum(v).over(frame) + lacking_left * F.first(v).over(whole) + lacking_right * F.last(v).over(whole)
    return df.withColumn(out, total / (2 * radius + 1))


def smoothed(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, kernel: list[float], out: str) -> DataFrame:
    """Convolution with an odd kernel; rows beyond the edges count as 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    r = len(kernel) // 2
    terms = [F.coalesce(F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w), F.lit(0.0)) * kernel[r + k] for k in range(-r, r + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(out, total)


def standardised(df: DataFrame, keys: Sequence[str], value: str, out: str, eps: float = 1e-6) -> DataFrame:
    """(x - mean) / sqrt(population variance + eps), by aggregates that are joined back."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.var_pop(value).alias("__v"))
    return df.join(stats, list(keys)).withColumn(out, (F.col(value) - F.col("__m")) / F.sqrt(F.col("__v") + eps)).drop("__m", "__v")


def robust_standardised(df: DataFrame, keys: Sequence[str], value: str, out: str, floor: float = 1e-6) -> DataFrame:
    """(x - median) / max(1.4826 x median absolute deviation, floor)."""
    mid = df.groupBy(*keys).agg(F.median(value).alias("__m"))
    x = df.join(mid, list(keys))
    mad = x.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("__m"))).alias("__d"))
    return x.join(mad, list(keys)).withColumn(out, (F.col(value) - F.col("__m")) / F.greatest(1.4826 * F.col("__d"), F.lit(floor))).drop("__m", "__d")


def rates(df: DataFrame, keys: Sequence[str], t: str, counter: str, out: str = "rate", scale: float = 1.0) -> DataFrame:
    """The rise of a counter over the time since the row before, not below 0; null for the first row and equal times."""
    w = Window.partitionBy(*keys).orderBy(t)
    dt = F.col(t).cast("double") - F.lag(F.col(t).cast("double")).over(w)
    rise = F.col(counter) - F.lag(counter).over(w)
    return df.withColumn(out, F.when(dt > 0, F.greatest(F.lit(0.0), scale * rise / dt)))


def monotone_totals(df: DataFrame, run: str, member: str, t: str, counter: str) -> DataFrame:
    """(run, t, total, peak): the members' counters added up, those that ended with their last value; and the largest total so far.

    A member's rises are summed along time, so that each row adds only its own change: one window a run over
    already aggregated changes, and no carrying forward of ended members.
    """
    own = Window.partitionBy(run, member).orderBy(t)
    best = F.max(counter).over(own.rowsBetween(Window.unboundedPreceding, 0))
    top = df.select(run, member, t, best.alias("b"))
    rises = top.select(run, t, (F.col("b") - F.coalesce(F.lag("b").over(own), F.lit(0))).alias("d")).groupBy(run, t).agg(F.sum("d").alias("d"))
    along = Window.partitionBy(run).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    totals = rises.select(run, t, F.sum("d").over(along).alias("total"))
    return totals.withColumn("peak", F.max("total").over(along))


def cell_edges(df: DataFrame, keys: Sequence[str], centre: str) -> DataFrame:
    """(keys, centre, low, high): midpoints between sorted distinct centres, mirrored at the ends; 0.5 to both sides for a single one."""
    x = df.select(*keys, centre).distinct()
    w = Window.partitionBy(*keys).orderBy(centre)
    before, after, c = F.lag(centre).over(w), F.lead(centre).over(w), F.col(centre)
    low = F.coalesce((before + c) / 2, c - (after - c) / 2, c - 0.5)
    high = F.coalesce((after + c) / 2, c + (c - before) / 2, c + 0.5)
    return x.select(*keys, centre, low.alias("low"), high.alias("high"))


def window_starts(length: Column, size: int, overlap: int, mode: str) -> Column:
    """ARRAY of starts of windows over `length` positions.

    `package`: steps of size - overlap until the end is reached, the last window short. `grid`: the same steps, but
    the last window moved left to full size. `clipped`: as `package` (for regions). Length 0 and null give none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    many = F.when(length <= size, F.lit(1)).otherwise(F.ceil((length - size) / step).cast("int") + 1)
    starts = F.transform(F.sequence(F.lit(0), many - 1), lambda i: i * step)
    if mode == "grid":
        starts = F.transform(starts, lambda s: F.when(length > size, F.least(s, length - size)).otherwise(s))
    elif mode not in ("package", "clipped"):
        raise ValueError(mode)
    return F.when(length > 0, starts)


def chunked(df: DataFrame, text: str, size: int, overlap: int, mode: str = "grid") -> DataFrame:
    """df with a row a window: chunk_index (from 1), chunks_total, aa_start, aa_end and chunk. Null and empty texts have no row.

    In mode `package` the total is the one of the old tool, ceil(length / size) rounded as if windows didn't
    overlap; `grid` counts the windows.
    """
    n = F.length(text)
    x = df.withColumn("__n", n).select("*", F.posexplode(window_starts(F.col("__n"), size, overlap, mode)).alias("__i", "aa_start"))
    step = size - overlap
    windows = F.when(F.col("__n") <= size, 1).otherwise(F.ceil((F.col("__n") - size) / step) + 1)
    total = F.ceil(F.col("__n") / size) if mode == "package" else windows
    return (
        x.withColumn("chunk_index", F.col("__i") + 1)
        .withColumn("chunks_total", total.cast("int"))
        .withColumn("aa_end", F.least(F.col("aa_start") + size, F.col("__n")))
        .withColumn("chunk", F.substr(F.col(text), F.col("aa_start") + 1, F.col("aa_end") - F.col("aa_start")))
        .drop("__i", "__n")
    )


def greedy_batches(df: DataFrame, size: str, order: str, most_size: int, most_rows: int, extra: int = 2) -> DataFrame:
    """df with a batch number: rows in order, a new batch where the sum of size + extra or the number of rows would pass its cap.

    The accumulator starts anew with each batch, so it runs over sorted rows within range partitions of `order`;
    batches don't cross partitions, and their number is (partition, batch) as STRUCT.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, rows = -1, 0, 0
        for frame in batches:
            out = []
            for n in frame[size].tolist():
                n = int(n) + extra
                if number < 0 or held + n > most_size or rows + 1 > most_rows:
                    number, held, rows = number + 1, 0, 0
                held, rows = held + n, rows + 1
                out.append(number)
            yield frame.assign(batch=np.array(out, np.int64))

    sorted_ = df.repartitionByRange(order).sortWithinPartitions(order)
    return sorted_.mapInPandas(run, fields + ", batch bigint")


def peaks(values: np.ndarray, prominence: float, distance: int) -> list[tuple[int, float]]:
    """(position, prominence) of the local maxima, the most prominent first; of maxima nearer than distance the higher stays.

    The prominence is the height above the higher of the lowest values on the way to higher ground on each side.
    Plateaus count at their middle (rounded down), ends never.
    """
    v = np.asarray(values, float)
    found, i = [], 1
    while i < len(v) - 1:
        j = i
        while j < len(v) - 1 and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j < len(v) - 1 and v[j + 1] < v[i]:
            found.append((i + j) // 2)
        i = j + 1
    keep: list[int] = []
    for p in sorted(found, key=lambda p: (-v[p], p)):
        if all(abs(p - q) >= distance for q in keep):
            keep.append(p)
    out = []
    for p in keep:
        left = v[: p + 1][::-1]
        right = v[p:]
        lows = []
        for side in (left, right):
            higher = np.flatnonzero(side > v[p])
            lows.append(side[: higher[0] if len(higher) else len(side)].min())
        height = float(v[p] - max(lows))
        if height >= prominence:
            out.append((p, height))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def find_peaks(df: DataFrame, key: str, values: str, prominence: float, distance: int) -> DataFrame:
    """(key, n, position, height): the peaks of each row's array, n from 1. Null and short arrays have none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(k, n, int(p), h) for k, v in zip(frame["key"], frame["v"]) if v is not None for n, (p, h) in enumerate(peaks(v, prominence, distance), 1)]
            yield pd.DataFrame(rows, columns=["key", "n", "position", "height"])

    x = df.select(F.col(key).alias("key"), F.col(values).cast("array<double>").alias("v"))
    return x.mapInPandas(run, f"key {kind}, n int, position int, height double").withColumnRenamed("key", key)


def scan_windows(df: DataFrame, length: str, size: int, stride: int, tail: bool = True) -> DataFrame:
    """df with a row a window: w_start, w_end (half-open). Steps of stride, and with tail a last window at the end; shorter sequences are one window."""
    n = F.col(length)
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - size, F.lit(0)) / stride).cast("int")), lambda i: i * stride)
    starts = F.array_distinct(F.concat(steps, F.array((n - size).cast("int")))) if tail else steps
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(starts)
    x = df.withColumn("w_start", F.explode(F.when(n > 0, starts)))
    return x.withColumn("w_end", F.least(F.col("w_start") + size, n))


def best_windows(df: DataFrame, keys: Sequence[str], length: str, size: int, stride: int, score: Column, tail: bool = True) -> DataFrame:
    """(keys, w_start, w_end, score): of each key the window with the largest score, the first of equal ones.

    score: an expression over df's columns, w_start and w_end. Windows are scored where they are made; only the best
    of each key travels.
    """
    x = scan_windows(df, length, size, stride, tail).withColumn("__s", score)
    best = x.groupBy(*keys).agg(F.max_by(F.struct("w_start", "w_end", "__s"), F.struct("__s", -F.col("w_start"))).alias("b"))
    return best.select(*keys, "b.w_start", "b.w_end", F.col("b.__s").alias("score"))
