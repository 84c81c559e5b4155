"""Overlapping and gapped intervals: continuous periods and the gaps between them, per entity.

Each entity's intervals live in an ordered map of disjoint intervals, the keyed state of a task (`KeyedMaps`). An
insertion finds the intervals it overlaps or touches by binary search and replaces them by their union, which also
closes or narrows the gaps between neighbours. The same map is the keyed state of the streaming form
(streaming/interval_state.py).

At scale: positions are cut into blocks of 2**BLOCK_BITS, so that the state of one (entity, block) is bounded
whatever share of the rows an entity holds. Every input partition first merges its own rows (a map-side
combine), then the partial periods are merged per (entity, block), and only the first and last period of a
block take part in joining blocks to each other. An interval has a piece in its first and in its last block; the whole
blocks between are one interval of block numbers, and such intervals are merged in the same way, one level up.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 16
#: Intervals that one task holds before it passes its partial periods on.
MOST_HELD = 1_000_000
BLANKS = " \t\r\n\f\v"


class IntervalMap:
    """Ordered disjoint closed intervals; those that share a position or follow each other directly are one."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts = [] if starts is None else starts
        self.ends = [] if ends is None else ends

    def insert(self, start: int, end: int) -> int:
        """Add [start, end]; returns by how many the number of intervals grew (at most 1, negative after merges)."""
        starts, ends = self.starts, self.ends
        first = bisect_left(ends, start - 1)
        last = bisect_right(starts, end + 1, first)
        if first == last:
            starts.insert(first, start)
            ends.insert(first, end)
            return 1
        if starts[first] > start:
            starts[first] = start
        top = ends[last - 1]
        ends[first] = end if end > top else top
        if last - first > 1:
            del starts[first + 1 : last]
            del ends[first + 1 : last]
        return 1 + first - last

    def periods(self) -> Iterator[tuple[int, int]]:
        return zip(self.starts, self.ends)

    def gaps(self) -> Iterator[tuple[int, int]]:
        return ((end + 1, start - 1) for end, start in zip(self.ends, self.starts[1:]))


def trimmed(column: Column) -> Column:
    return F.btrim(column, F.lit(BLANKS))


class KeyedMaps:
    """The state of a task: an interval map for each (entity, block)."""

    def __init__(self) -> None:
        self.maps: dict[tuple, IntervalMap] = {}
        self.size = 0

    def insert(self, batch: pd.DataFrame) -> None:
        maps, size = self.maps, self.size
        for key, block, start, end in zip(batch["key"].tolist(), batch["block"].tolist(), batch["s"].tolist(), batch["e"].tolist()):
            found = maps.get((key, block))
            if found is None:
                maps[(key, block)] = IntervalMap([start], [end])
                size += 1
            else:
                size += found.insert(start, end)
        self.size = size

    def leave(self, keep: tuple | None = None) -> list[tuple[tuple, IntervalMap]]:
        """Take all maps out of the state, but for that of `keep`."""
        kept = self.maps.pop(keep, None)
        out = list(self.maps.items())
        self.maps = {} if kept is None else {keep: kept}
        self.size = 0 if kept is None else len(kept.starts)
        return out


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state = KeyedMaps()

    def flush() -> pd.DataFrame:
        rows = [(key, block, start, end) for (key, block), m in state.leave() for start, end in m.periods()]
        return pd.DataFrame(rows, columns=["key", "block", "s", "e"])

    for batch in batches:
        state.insert(batch)
        if state.size > MOST_HELD:
            yield flush()
    if state.size:
        yield flush()


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (key, block) to rows of kind edge (first and last of a block), period and gap (final).

    As rows are sorted, the maps of a batch are final but for the last one, which stays in the state.
    """
    state = KeyedMaps()

    def emit(keep: tuple | None) -> pd.DataFrame:
        out: list[tuple] = []
        for (key, block), held in state.leave(keep):
            n = len(held.starts)
            for i, (start, end) in enumerate(held.periods()):
                out.append((key, block, "edge" if i in (0, n - 1) else "period", start, end))
            out.extend((key, block, "gap", start, end) for start, end in held.gaps())
        return pd.DataFrame(out, columns=["key", "block", "kind", "s", "e"])

    for batch in batches:
        if len(batch):
            state.insert(batch)
            done = emit((batch["key"].iloc[-1], int(batch["block"].iloc[-1])))
            if len(done):
                yield done
    if state.size:
        yield emit(None)


def _merged(rows: DataFrame) -> DataFrame:
    """(key, kind, s, e) of intervals (key, lo, hi) in order; both ends inside."""
    size = 1 << BLOCK_BITS
    first, last = F.shiftright("lo", BLOCK_BITS), F.shiftright("hi", BLOCK_BITS)
    widest = rows.agg(F.max(last - first)).first()[0]
    cut = rows.select("key", "lo", "hi", F.explode(F.array_distinct(F.array(first, last))).alias("block")).select(
        "key",
        "block",
        F.greatest("lo", F.col("block") * size).alias("s"),
        F.least("hi", F.col("block") * size + (size - 1)).alias("e"),
    )
    partial = cut.mapInPandas(_combine, "key string, block bigint, s bigint, e bigint")
    merged = (
        partial.repartition("key", "block")
        .sortWithinPartitions("key", "block")
        .mapInPandas(_finish, "key string, block bigint, kind string, s bigint, e bigint")
    )
    # The edges of the blocks, at most two rows a block, are joined along each key; all else is final.
    edges = merged.filter("kind = 'edge'").select("key", "block", "s", "e", F.lit(None).cast("bigint").alias("upto"))
    inner = merged.filter("kind <> 'edge'")
    wide = widest is not None and widest > 1
    if wide:
        whole = _merged(rows.filter(last - first > 1).select("key", (first + 1).alias("lo"), (last - 1).alias("hi"))).filter("kind = 'period'")
        edges = edges.unionByName(whole.select("key", F.col("s").alias("block"), (F.col("s") * size).alias("s"), (F.col("e") * size + (size - 1)).alias("e"), F.col("e").alias("upto")))
    order = Window.partitionBy("key").orderBy("s", F.desc("e"))
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("before", F.max("e").over(ahead)).withColumn("covered", F.coalesce(F.max("upto").over(ahead) >= F.col("block"), F.lit(False)))
    edges = edges.withColumn("starts", F.when(F.col("s") <= F.col("before") + 1, 0).otherwise(1)).withColumn("run", F.sum("starts").over(order))
    if wide:  # nothing within the blocks that are covered as a whole is a period or gap of its own
        inner = inner.join(edges.filter("covered and upto is null").select("key", "block").distinct(), ["key", "block"], "left_anti")
    joined = edges.groupBy("key", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("key", F.lit("period").alias("kind"), "s", "e")
    between = edges.filter((F.col("starts") == 1) & F.col("before").isNotNull() & (F.shiftright("before", BLOCK_BITS) != F.col("block"))).select(
        "key", F.lit("gap").alias("kind"), (F.col("before") + 1).alias("s"), (F.col("s") - 1).alias("e")
    )
    return inner.select("key", "kind", "s", "e").unionByName(joined).unionByName(between)


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, kind, start, end): each continuous `period` of a key and each `gap` between two neighbouring periods.

    Both ends are inside, of the input and of the result. The key is trimmed of surrounding white space.
    Rows with a null key, start or end are left out; reversed ends are put in order; repeated rows count
    once; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = df.select(
        trimmed(F.col(f"`{key}`").cast("string")).alias("key"),
        F.least(F.col(f"`{start}`"), F.col(f"`{end}`")).cast("bigint").alias("lo"),
        F.greatest(F.col(f"`{start}`"), F.col(f"`{end}`")).cast("bigint").alias("hi"),
        (F.col(f"`{start}`").isNotNull() & F.col(f"`{end}`").isNotNull()).alias("whole"),
    ).filter(F.col("key").isNotNull() & F.col("whole"))
    return _merged(rows.drop("whole")).select(F.col("key").alias(key), "kind", F.col("s").alias(start), F.col("e").alias(end))
