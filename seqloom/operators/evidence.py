"""Evidence from several sources for one key: ranked hits, spans, overlaps and ordered rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import evidence_confidence, half_open
from .intervals import intersection, union_length


def first_match(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that is true; null conditions are false."""
    out = None
    for condition, name in rules:
        c = F.coalesce(condition, F.lit(False))
        out = F.when(c, name) if out is None else out.when(c, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def chosen_span(lo: Column, hi: Column, lo2: Column, hi2: Column, least: int = 30, most: int = 400, least2: int = 30, most2: int = 600) -> Column:
    """STRUCT<source, lo, hi, reason> of two 1-based closed spans, the second only where the first is missing or reversed, not where its length is out of range."""
    n, n2 = hi - lo + 1, hi2 - lo2 + 1
    # The names of the sources and the beginnings of the reasons.
    span = lambda source, a, b, reason: F.struct(F.lit(source).alias("source"), a.cast("int").alias("lo"), b.cast("int").alias("hi"), reason.alias("reason"))
    none, null = "", F.lit(None).cast("int")
    why = F.when(hi < lo, F.concat(F.lit("pp_wrapped:"), lo.cast("string"), F.lit(">"), hi.cast("string"))).otherwise(F.lit("pp_missing"))
    return (
        F.when(hi >= lo, F.when(n.between(least, most), span("pp", lo, hi, F.lit("valid_pp"))).otherwise(span(none, null, null, F.concat(F.lit("pp_len_out_of_range:"), n.cast("string")))))
        .when(hi2 >= lo2, F.when(n2.between(least2, most2), span("ext", lo2, hi2, F.concat(F.lit("fallback_ext_after_"), why))).otherwise(span(none, null, null, F.concat(F.lit("ext_len_out_of_range:"), n2.cast("string")))))
        .otherwise(span(none, null, null, why))
    )


#: The codes of a decision, in the order in which their conditions are looked at; the first letter is the label.
DECISIONS = (
    "P_RESCUED_BY_CLEAN_PALM_SPAN",
    "P_CONSENSUS_CLEAN_PP",
    "P_CONSENSUS_CLEAN_EXT",
    "N_NONRDRP_PFAM_OR_CDD_DOMINANT",
    "U_PALM_SPAN_CONFLICTS_WITH_NONRDRP_PFAM_OR_CDD",
    "U_NO_USABLE_PALM_SPAN",
    "U_RDRPCATCH_CONFLICTS_WITH_NONRDRP_PFAM_OR_CDD",
    "U_FULL_NONRDRP_BUT_RDRPCATCH_POSITIVE",
    "U_RDRPCATCH_ONLY_OR_LOW_PALM_SCORE",
    "U_PALMANNOT_ONLY",
    "U_PALMANNOT_LOW_SCORE_ONLY",
    "U_NO_HIGH_CONFIDENCE_SIGNAL",
)


def decision(hit: Column, hit_conflict: Column, score: Column, strong: Column, span_source: Column, span_conflict: Column, covered: Column) -> Column:
    """The code of a record's evidence. Null conditions are false.

    hit, strong: whether the profile search, and the score of the annotation, are positive. hit_conflict, span_conflict:
    whether other domains overlap the span of each too much. span_source: `pp`, `ext` or empty for no usable span.
    covered: whether other domains cover most of the record. score: of the annotation, null where there is none.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    hit, strong, clash, span_clash, full = yes(hit), yes(strong), yes(hit_conflict), yes(span_conflict), yes(covered)
    usable = yes(span_source.isin("pp", "ext"))
    both, only_hit = hit & strong, hit & ~strong
    clean = both & usable & ~span_clash
    conditions = (
        clean & clash,
        clean & (span_source == "pp"),
        clean,
        full & ~hit & ~strong,
        both & usable & span_clash,
        both & ~usable,
        only_hit & clash,
        only_hit & full,
        only_hit,
        strong & ~hit,
        score > 0,
    )
    return first_match(list(zip(conditions, DECISIONS)), DECISIONS[-1])


def source_names(names: dict[str, Column]) -> Column:
    """The names whose condition is true, joined with `+`."""
    return F.array_join(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in names.items())), lambda x: x.isNotNull()), "+")


def hit_coverage(hits: DataFrame, lengths: DataFrame, key: str, start: str, end: str, excluded: DataFrame | None = None, on: str | None = None, most_evalue: float | None = None, evalue: str = "i_evalue") -> DataFrame:
    """(key, length, covered, coverage): union of the hits by key over its length; the coverage may exceed 1.

    Left out are hits whose `on` is in excluded, with an e-value above most_evalue, or with an empty interval.
    """
    x = hits
    if most_evalue is not None:
        x = x.filter(F.col(evalue) <= most_evalue)
    if excluded is not None:
        x = x.join(excluded.select(on).distinct(), on, "left_anti")
    iv = x.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(key, half_open(F.col(start), F.col(end)).alias("iv")).select(key, "iv.s", "iv.e").filter("s < e")
    covered = union_length(iv, [key])
    return lengths.select(key, "length").join(covered.withColumnRenamed("length", "covered"), key, "left").select(key, "length", F.coalesce("covered", F.lit(0)).cast("bigint").alias("covered"), (F.coalesce("covered", F.lit(0)) / F.nullif(F.col("length"), F.lit(0))).alias("coverage"))


def overlap_with_span(hits: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, overlap): positions of the key's span that hits cover; both half-open (key, s, e)."""
    return intersection(hits, spans, [key]).groupBy(key).agg(F.sum(F.col("e") - F.col("s")).cast("bigint").alias("overlap"))


def conflict(overlap: Column, span_length: Column, least: int, share: float) -> Column:
    """Whether an overlap is of at least `least` positions and at least that share of the span."""
    return (F.coalesce(overlap, F.lit(0)) >= least) & (F.coalesce(overlap, F.lit(0)) >= share * span_length)


def normalised_span(s: Column, e: Column, length: Column, k: float = 2.0) -> Column:
    """STRUCT<S, E, truncated, w_min, sigma> of a half-open span, clamped to the length; nulls for empty spans."""
    a, b = F.greatest(F.lit(0), F.least(s, length)), F.greatest(F.lit(0), F.least(e, length))
    least = F.greatest(70.0 / F.greatest(F.lit(1.0), length.cast("double")), F.lit(0.02))
    ok = (b > a) & (length > 0)
    return F.struct(
        F.when(ok, a / length).alias("S"),
        F.when(ok, b / length).alias("E"),
        F.when(ok, (a == 0) | (b == length)).otherwise(False).alias("truncated"),
        least.alias("w_min"),
        F.when(ok, F.greatest((b - a) / length / (2 * k), least / 2)).alias("sigma"),
    )


__all__ = ["DECISIONS", "chosen_span", "conflict", "decision", "evidence_confidence", "first_match", "hit_coverage", "normalised_span", "overlap_with_span", "source_names"]
