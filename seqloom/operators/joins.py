"""Joins by containment, as equi-joins on substrings instead of comparing all pairs.

In `mentions`, the windows of a text that can be a pattern are found in numpy over the bytes of a whole Arrow batch:
the hash of every window of a pattern's length comes from prefix sums of a polynomial (modulo 2**64), and a bitmap of
the patterns' hashes drops nearly all windows that are no pattern. Only the windows that are left become rows, without
the text, and an equi-join on their bytes decides. Bytes will do, as UTF-8 has no character within another one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import best_rows

#: Distinct lengths of patterns that one join takes.
MOST_LENGTHS = 1000
#: Bytes hashed at once, few enough for a CPU's cache.
BLOCK = 1 << 16
#: Slots of the bitmap by pattern, and the bits of the smallest and largest bitmap.
SLOTS, LEAST_BITS, MOST_BITS = 64, 16, 24
#: Bytes of places and of windows before repeated ones are dropped, and of rows given back at once.
HELD = 1 << 24
#: Base of the polynomial, its inverse modulo 2**64, and a factor that spreads sums over the high bits.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPREAD = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(max(n, 1), base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other, and where each begins and the last one ends. No nulls."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def pattern_bits(patterns: pa.Array, bits: int) -> np.ndarray:
    """A bitmap of 2**bits slots with the hashes of patterns, none of them null or empty."""
    slots = np.zeros(1 << bits, bool)
    data, offsets = _bytes(patterns)
    if len(data):
        sizes = np.diff(offsets)
        within = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
        sums = np.add.reduceat(data.astype(np.uint64) * _powers(BASE, int(sizes.max()))[within], offsets[:-1])
        slots[(sums * np.uint64(SPREAD)) >> np.uint64(64 - bits)] = True
    return slots


def _windows(data: np.ndarray, row: np.ndarray, at: np.ndarray, n: int) -> pa.Table:
    """Distinct (row, window) of the windows of n bytes at the places."""
    parts, step = [], max(1, HELD // n)
    for i in range(0, len(at), step):
        places = at[i : i + step]
        cut = np.lib.stride_tricks.sliding_window_view(data, n)[places]
        ends = np.arange(len(places) + 1, dtype=np.int64) * n
        found = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(cut)])
        parts.append(_distinct(pa.table({"row": row[i : i + step], "c": found})))
    return _distinct(pa.concat_tables(parts)) if len(parts) > 1 else parts[0]


def _distinct(t: pa.Table) -> pa.Table:
    return t.group_by(["row", "c"], use_threads=False).aggregate([])


def finder(lengths: Sequence[int], slots: np.ndarray, block: int = BLOCK) -> Callable[[pa.Array], pa.Table]:
    """A function that gives the distinct (row, c) of texts (no nulls).

    Each window c of one of the lengths (in bytes) whose hash is in the bitmap, and the empty one for length 0.
    """
    lengths = sorted(lengths)
    top = max(lengths, default=0)
    shift = np.uint64(64 - (len(slots).bit_length() - 1))
    room = {"n": 0}

    def run(texts: pa.Array) -> pa.Table:
        data, offsets = _bytes(texts)
        wide = min(block + top, len(data) + 1)
        if wide > room["n"]:
            room.update(n=wide, up=_powers(BASE, wide), down=_powers(INVERSE, wide) * np.uint64(SPREAD))
        up, down = room["up"], room["down"]
        none = pa.table({"row": pa.array([], pa.int64()), "c": pa.array([], pa.large_binary())})
        parts: list[pa.Table] = [none]
        held: dict[int, list] = {n: [] for n in lengths}
        hits = 0

        def flush() -> None:
            for n in lengths:
                if held[n]:
                    row, at = (np.concatenate(x) for x in zip(*held[n]))
                    parts.append(_windows(data, row, at, n))
                    held[n] = []

        if 0 in held:
            parts.append(pa.table({"row": np.arange(len(texts)), "c": pa.array([b""] * len(texts), pa.large_binary())}))
        for first in range(0, len(data), block):
            part = data[first : first + block + top - 1]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            for n in lengths:
                m = min(block, len(part) - n + 1)
                if n == 0 or m <= 0:
                    continue
                h = sums[n : n + m] - sums[:m]
                h *= down[:m]
                h >>= shift
                at = np.flatnonzero(slots.take(h.view(np.int64))) + first
                if len(at):
                    row = np.searchsorted(offsets, at, side="right") - 1
                    whole = at + n <= offsets[row + 1]
                    if not whole.any():
                        continue
                    held[n].append((row[whole], at[whole]))
                    hits += int(whole.sum())
                    if hits * 16 > HELD:
                        flush()
                        hits = 0
        flush()
        return _distinct(pa.concat_tables(parts)) if len(parts) > 2 else parts[-1]

    return run


def mentions(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """The columns `keep` of texts and the pattern, for each pair of rows where the pattern is part of the text.

    As a join on contains(text, pattern): repeated texts and patterns give repeated pairs, null ones none, and the empty
    pattern is part of every text. The work grows with the texts times the number of distinct lengths of patterns
    (at most MOST_LENGTHS, else an error), not with the pairs; texts are not shuffled.
    """
    p = patterns.select(F.col(pattern).alias(pattern), F.col(pattern).cast("binary").alias("__c")).filter("__c is not null")
    each = p.groupBy(F.length(pattern).alias("n")).agg(F.count("*").alias("rows"), F.collect_set(F.octet_length(pattern)).alias("bytes")).limit(MOST_LENGTHS + 1).collect()
    if len(each) > MOST_LENGTHS:
        raise ValueError(f"patterns of more than {MOST_LENGTHS} lengths")
    lengths = sorted({n for r in each for n in r.bytes})
    bits = min(max((SLOTS * sum(r.rows for r in each)).bit_length(), LEAST_BITS), MOST_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << bits, bool)
        for batch in batches:
            slots |= pattern_bits(batch.column(0), bits)
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(slots).tobytes()], pa.binary())], ["bits"])

    marked = p.filter("octet_length(__c) > 0").select("__c").coalesce(8).mapInArrow(mark, "bits binary").collect()
    packed = np.zeros(1 << (bits - 3), np.uint8)
    for r in marked:
        packed |= np.frombuffer(r.bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(lengths, np.unpackbits(packed).view(bool))
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column("__t")
            found = find(t)
            if not found.num_rows:
                continue
            row = found["row"].to_numpy()
            # Rows that are given back at once, as kept columns can be as long as the text.
            share = np.cumsum((np.diff(_bytes(t)[1])[row] if keep else 0) + np.diff(_bytes(found["c"].combine_chunks())[1]) + 16) // HELD
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1), len(row)]
            for a, b in zip(cuts, cuts[1:]):
                columns = [batch.column(k).take(pa.array(row[a:b])) for k in keep]
                yield pa.RecordBatch.from_arrays([*columns, found["c"][a:b].combine_chunks().cast(pa.binary())], [*keep, "__c"])

    schema = ", ".join([*(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keep), "__c binary"])
    t = texts.select(*keep, F.col(text).cast("binary").alias("__t")).filter("__t is not null")
    return t.mapInArrow(run, schema).join(p, "__c").drop("__c")


def contains_join(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Distinct (text, pattern) where the pattern is part of the text.

    The substrings of every text of the lengths that patterns have are joined with the patterns, so the work grows
    with the texts times the number of distinct lengths (at most MOST_LENGTHS, else an error), not with the pairs.
    Null and empty texts and patterns match nothing. Each place of a text becomes a row with the text, so this is
    for short ones, such as ids; long ones are for `mentions`.
    """
    p = patterns.select(F.col(pattern).alias("__p")).filter("length(__p) > 0").distinct()
    lengths = [r.n for r in p.select(F.length("__p").alias("n")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"patterns of more than {MOST_LENGTHS} lengths")
    t = texts.select(F.col(text).alias("__t")).filter("length(__t) > 0").distinct()
    n = F.explode(F.array(*map(F.lit, sorted(lengths))) if lengths else F.array().cast("array<int>"))
    t = t.select("__t", n.alias("n")).filter("n <= length(__t)").select("__t", "n", F.explode(F.sequence(F.lit(1), F.length("__t") - F.col("n") + 1)).alias("i"))
    t = t.select("__t", F.substr(F.col("__t"), F.col("i"), F.col("n")).alias("__p"))
    return t.join(p, "__p").select(F.col("__t").alias(text), F.col("__p").alias(pattern)).distinct()


def cascade_match(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """(a, b, how) for each distinct a: the equal b; else the only b that contains a or that a contains; else null.

    how: `exact`, `contained`, `ambiguous` (several candidates, b null) or `none`.
    """
    x = left.select(F.col(a).alias("a")).filter("a is not null").distinct()
    y = right.select(F.col(b).alias("b")).filter("b is not null").distinct()
    exact = x.join(y, F.col("a") == F.col("b")).select("a", "b")
    rest = x.join(exact.select("a"), "a", "left_anti")
    inside = contains_join(y, "b", rest, "a").select("a", "b").unionByName(contains_join(rest, "a", y, "b").select("a", "b"))
    found = inside.groupBy("a").agg(F.countDistinct("b").alias("n"), F.min("b").alias("b"))
    loose = rest.join(found, "a", "left").select("a", F.when(F.col("n") == 1, F.col("b")).alias("b"), F.when(F.col("n") == 1, "contained").when(F.col("n") > 1, "ambiguous").otherwise("none").alias("how"))
    out = exact.withColumn("how", F.lit("exact")).unionByName(loose)
    return out.select(F.col("a").alias(a), F.col("b").alias(b) if a != b else F.col("b").alias(f"{b}_matched"), "how")


def allowed(df: DataFrame, key: str, ids: DataFrame, most: int = 1000) -> DataFrame:
    """The rows of df whose key is in the first column of ids: a filter that reaches the scan for up to `most` ids, a semi-join for more."""
    wanted = ids.select(F.col(ids.columns[0]).alias("__id")).filter("__id is not null").distinct()
    few = [r[0] for r in wanted.limit(most + 1).collect()]
    if len(few) <= most:
        return df.filter(F.col(key).isin(few))
    return df.join(wanted, F.col(key) == F.col("__id"), "left_semi")


def with_best(df: DataFrame, scores: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """df with columns of the best row of scores for its keys, null where there is none."""
    return df.join(best_rows(scores, keys, order).select(*keys, *columns), list(keys), "left")


def looked_up(df: DataFrame, on: str, table: DataFrame, key: str, value: str, out: str, default: Column | None = None) -> DataFrame:
    """df with the value that table (unique keys) has for df's column `on`, else the default."""
    x = df.join(table.select(F.col(key).alias("__k"), F.col(value).alias("__v")), F.col(on) == F.col("__k"), "left")
    return x.withColumn(out, F.col("__v") if default is None else F.coalesce("__v", default)).drop("__k", "__v")


def with_lists(df: DataFrame, key: str, found: DataFrame, item: Column, out: str, source: str) -> DataFrame:
    """df with the sorted distinct items that found has for its key, an empty list if none, and whether there are any in `source`.

    For keys with a bounded number of items, such as the predictions of a chunk.
    """
    lists = found.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("__l"))
    kind = lists.schema["__l"].dataType
    x = df.join(lists, key, "left")
    return x.withColumn(out, F.coalesce("__l", F.array().cast(kind))).withColumn(source, F.when(F.col("__l").isNull(), "missing").otherwise("found")).drop("__l")
