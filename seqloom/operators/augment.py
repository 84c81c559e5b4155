"""Random crops, dropped tokens and noise of token vectors, all by hashes of a seed and an id."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import span_index


def uniform(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11) / float(1 << 53)


def random_crop(length: Column, size: int, seed: int, key: Column) -> Column:
    """STRUCT<start, end> of a window of `size` positions (all for shorter ones) at a random place."""
    width = F.least(F.lit(size), length)
    start = F.floor(uniform(seed, key) * (length - width + 1)).cast("int")
    return F.struct(start.alias("start"), (start + width).alias("end"))


def span_crop(length: Column, size: int, s: Column, e: Column, seed: int, key: Column, jitter: float = 0.1) -> Column:
    """STRUCT<start, end, S, E>: a window around the middle of a span [s, e] in [0, 1], moved by up to jitter of its size, and the span in it.

    The middle lies in the window: where the jitter moves it out, the window is not moved.
    """
    width = F.least(F.lit(size), length)
    a, b = span_index(s, length), span_index(e, length)
    middle = F.floor((a + b) / 2).cast("int")
    shift = F.bround((2 * uniform(seed, key) - 1) * jitter * width).cast("int")
    place = lambda by: F.greatest(F.lit(0), F.least(middle - F.floor(width / 2).cast("int") + by, length - width))
    moved = place(shift)
    start = F.when(middle.between(moved, moved + width - 1), moved).otherwise(place(F.lit(0)))
    inside = lambda x: F.greatest(F.lit(0), F.least(x - start, width - 1)) / F.greatest(width - 1, F.lit(1))
    whole = width == length
    return F.struct(start.alias("start"), (start + width).alias("end"), F.when(whole, s).otherwise(F.least(inside(a), inside(b))).alias("S"), F.when(whole, e).otherwise(F.greatest(inside(a), inside(b))).alias("E"))


def kept_tokens(length: Column, p: float, seed: int, key: Column, protected: Column | None = None, around: int = 0) -> Column:
    """ARRAY<BOOLEAN> of `length`: false with probability p, but not within `around` of the protected index, and never all false."""
    draws = F.transform(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), lambda i: uniform(seed, key, i))
    safe = lambda i: F.coalesce(F.abs(i - protected) <= around, F.lit(False)) if protected is not None else F.lit(False)
    kept = F.transform(draws, lambda u, i: (u > p) | safe(i))
    last = F.floor(uniform(seed + 1, key) * length).cast("int")
    some = F.when(F.exists(kept, lambda x: x), kept).otherwise(F.transform(kept, lambda x, i: i == last))
    return F.when(length <= 1, F.transform(draws, lambda u: F.lit(True))).otherwise(some)


def with_noise(vector: Column, sigma: float, seed: int, key: Column) -> Column:
    """Normal noise of spread sigma added to each number, by the Box-Muller transform of two hashes."""
    if sigma <= 0:
        return vector
    normal = lambda i: F.sqrt(-2 * F.log(1 - uniform(seed, key, i))) * F.cos(2 * math.pi * uniform(seed + 1, key, i))
    return F.transform(vector, lambda x, i: x.cast("double") + sigma * normal(i))
