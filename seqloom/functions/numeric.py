"""Scores, coordinates and vectors as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def calibrated(logit: Column, temperature: Column) -> Column:
    """logit / temperature; null where the temperature is 0 or null."""
    return logit / F.nullif(temperature, F.lit(0.0))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def evalue_score(evalue: Column) -> Column:
    """-log10 of an e-value: 0 for null, and values of 0 or less count as 1e-300."""
    return F.when(evalue.isNull(), 0.0).otherwise(-F.log10(F.when(evalue <= 0, 1e-300).otherwise(evalue)))


def evidence_confidence(evalue: Column, coverage: Column, profile_coverage: Column, truncated: Column, least: float = 3.0, most: float = 30.0) -> Column:
    """0.6 x saturated score + 0.3 x coverage of 0.60 + 0.1 x profile coverage; half of it for truncated spans. Nulls count as 0."""
    if most > least:
        score = clip01((evalue_score(evalue) - least) / (most - least))
    else:
        score = (evalue_score(evalue) >= least).cast("double")
    whole = 0.6 * score + 0.3 * clip01(F.coalesce(coverage, F.lit(0.0)) / 0.60) + 0.1 * clip01(F.coalesce(profile_coverage, F.lit(0.0)))
    return whole * F.when(truncated, 0.5).otherwise(1.0)


def half_open(start: Column, end: Column) -> Column:
    """1-based closed ends in any order to STRUCT<s, e>, 0-based half-open, not below 0; nulls if an end is null."""
    both = start.isNotNull() & end.isNotNull()
    low, high = F.greatest(F.lit(0), F.least(start, end) - 1), F.greatest(F.lit(0), F.greatest(start, end))
    return F.struct(F.when(both, low).cast("int").alias("s"), F.when(both, high).cast("int").alias("e"))


def one_based(start: Column, end: Column, mode: str) -> Column:
    """STRUCT<s, e>, 1-based and closed, in order; nulls if an end is null. mode: `closed1`, `closed0` (0-based, both inside) or `open0` (half-open)."""
    shift = {"closed1": (0, 0), "closed0": (1, 1), "open0": (1, 0)}[mode]
    s, e = start + shift[0], end + shift[1]
    both = start.isNotNull() & end.isNotNull()
    return F.struct(F.when(both, F.least(s, e)).alias("s"), F.when(both, F.greatest(s, e)).alias("e"))


def span_index(norm: Column, length: Column) -> Column:
    """The index of a position in [0, 1]: rounded half to even, within the sequence."""
    return F.greatest(F.lit(0), F.least(length - 1, F.bround(norm * (length - 1)).cast("int")))


def span_indexes(s: Column, e: Column, length: Column) -> Column:
    """STRUCT<s, e> of indexes in order."""
    a, b = span_index(s, length), span_index(e, length)
    return F.struct(F.least(a, b).alias("s"), F.greatest(a, b).alias("e"))


def span_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over union of two spans of real numbers; 0 for an empty union."""
    inter = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    union = (e1 - s1) + (e2 - s2) - inter
    return F.when(union <= 0, 0.0).otherwise(inter / F.nullif(union, F.lit(0.0)))


def hull_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Of two closed spans of whole numbers: overlap over the length from the first start to the last end; null if an end is null."""
    inter = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(known, inter / (F.greatest(e1, e2) - F.least(s1, s2) + 1))


def bound(value: Column, use) -> Column:
    """use(value), the value being computed once for a row, also within lambdas over arrays."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalised(v: Column, eps: float = 1e-8) -> Column:
    """Of length 1; vectors of a length up to eps are left as they are."""
    return bound(norm(v), lambda n: F.transform(v, lambda x: F.when(n <= eps, x.cast("double")).otherwise(x.cast("double") / n)))


def all_finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def positions(length: Column, closed: bool = True) -> Column:
    """i / (L - 1), or i / L, for i from 0 on; 0 for lengths up to 1; an empty array for length 0."""
    over = F.greatest(F.lit(1), length - 1 if closed else length)
    return F.when(length < 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when(length <= 1, 0.0).otherwise(i / over)))


def masked_softmax(logits: Column, mask: Column) -> Column:
    """Softmax over the positions with a true mask, 0 elsewhere; all 0 for an empty mask."""
    inside = F.zip_with(logits, mask, lambda x, m: F.when(m, x.cast("double")))
    raised = bound(inside, lambda v: bound(F.array_max(v), lambda top: F.transform(v, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0)))))
    return bound(raised, lambda v: bound(F.nullif(total(v), F.lit(0.0)), lambda t: F.transform(v, lambda x: F.coalesce(x / t, F.lit(0.0)))))


def softmax(v: Column) -> Column:
    raised = bound(v, lambda a: bound(F.array_max(a).cast("double"), lambda top: F.transform(a, lambda x: F.exp(x.cast("double") - top))))
    return bound(raised, lambda a: bound(total(a), lambda t: F.transform(a, lambda x: x / t)))


def entropy(weights: Column) -> Column:
    """-sum w ln w / ln max(L, 2), weights not below 1e-12."""
    s = lambda ws: F.aggregate(ws, F.lit(0.0), lambda t, w: t - F.greatest(w, F.lit(1e-12)) * F.log(F.greatest(w, F.lit(1e-12))))
    return bound(weights, lambda ws: s(ws) / F.log(F.greatest(F.size(ws), F.lit(2)).cast("double")))


def shortest_mass(weights: Column, mass: float) -> Column:
    """STRUCT<len, r, l>: the shortest run of positions with a sum of at least mass (within 1e-12), the first of equal ones.

    For short arrays, as every pair of ends is looked at; long ones go through operators.model.hpd_spans.
    """
    n = F.size(weights)
    sums = F.transform(F.sequence(F.lit(0), n), lambda i: F.aggregate(F.slice(weights, 1, i), F.lit(0.0), lambda t, x: t + x))
    ends = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda l: F.array_min(F.transform(F.filter(F.sequence(l + 1, n), lambda r: F.element_at(sums, r + 1) - F.element_at(sums, l + 1) >= mass - 1e-12), lambda r: F.struct((r - l).alias("len"), (r - 1).alias("r"), l.alias("l")))),
    )
    return F.array_min(F.filter(ends, lambda x: x.isNotNull()))


def soft_mask(weights: Column, s: Column, e: Column, ramp: float) -> Column:
    """1 within [s, e] of normalised positions, a cosine slope of width ramp (0 to 0.25) outside, 0 beyond and where the weight is 0."""
    width = min(0.25, max(0.0, ramp))
    n = F.size(weights)

    def value(w: Column, i: Column) -> Column:
        x = F.when(n <= 1, 0.0).otherwise(i / F.greatest(n - 1, F.lit(1)))
        away = F.greatest(s - x, x - e)
        slope = 0.5 * (1 + F.cos(F.lit(math.pi) * away / width)) if width else F.lit(0.0)
        return F.when(w == 0, 0.0).when(away <= 0, 1.0).when(away < width, slope).otherwise(0.0)

    return F.transform(weights, value)


def scaled(value: Column, low: Column, high: Column, gamma: float = 1.0) -> Column:
    """0 to 100 by the place between low and high to the power gamma (1 if not above 0); 50 where they are equal."""
    return F.when(high <= low, 50.0).otherwise(100 * F.pow((value - low) / F.nullif(high - low, F.lit(0.0)), F.lit(gamma if gamma > 0 else 1.0)))


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights of a kernel that reaches three sigma to each side and adds up to 1; one weight for sigma up to 0."""
    if sigma <= 0:
        return [1.0]
    reach = max(1, math.ceil(3 * sigma))
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    return [x / sum(raw) for x in raw]


def gib(bytes_: Column) -> Column:
    return bytes_ / float(1 << 30)


def finite_or_null(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clamped_span(span: Column, length: Column) -> Column:
    """A 1-based closed STRUCT<s, e> moved into 1..length, in order; nulls for lengths below 1."""
    at = lambda x: F.when(length > 0, F.greatest(F.lit(1), F.least(x, length)))
    s, e = at(span["s"]), at(span["e"])
    both = s.isNotNull() & e.isNotNull() & span["s"].isNotNull() & span["e"].isNotNull()
    return F.struct(F.when(both, F.least(s, e)).alias("s"), F.when(both, F.greatest(s, e)).alias("e"))


def hit_confidence(hits: Column) -> Column:
    """ln(1 + hits) / ln 4, at most 1: the variant that counts hits."""
    return clip01(F.log1p(F.coalesce(hits, F.lit(0)).cast("double")) / math.log(4))


def fit_quality(rss: Column, tss: Column, n: Column, parameters: int) -> Column:
    """STRUCT<r2, aic, bic> of a fit; r2 is null for no variation, the criteria for no residuals or points."""
    scaled = F.when((rss > 0) & (n > 0), n * F.log(rss / n))
    return F.struct(F.when(tss > 0, 1 - rss / F.nullif(tss, F.lit(0.0))).alias("r2"), (scaled + 2 * parameters).alias("aic"), (scaled + parameters * F.log(n.cast("double"))).alias("bic"))


def token_vectors(vectors: Column, length: Column, width: int) -> Column:
    """Token vectors repaired: turned where they lie by dimension, and without the marks of beginning and end where there are two more than residues.

    vectors: ARRAY<ARRAY<FLOAT>>. Null where the number of tokens doesn't fit the length then.
    """
    first = F.size(F.get(vectors, F.lit(0)))
    turned = F.transform(F.sequence(F.lit(0), F.greatest(first - 1, F.lit(0))), lambda i: F.transform(vectors, lambda v: F.get(v, i)))
    lies = (first != width) & (F.size(vectors) == width)
    return bound(F.when(lies, turned).otherwise(vectors), lambda v: F.when(F.size(v) == length + 2, F.slice(v, 2, length)).when(F.size(v) == length, v))
