"""Losses of a classifier and of predicted spans, as aggregates over rows of predictions, for evaluation.

Labels are 2 (positive), 1 (unlabelled) and 0 (negative). A loss over no rows is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cross_entropy(logit: Column, target: Column) -> Column:
    """Of a logit and a target in [0, 1], without overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def _mean(value: Column, where: Column) -> Column:
    return F.coalesce(F.avg(F.when(where, value)), F.lit(0.0))


def nonnegative_pu(logit: Column, label: Column, prior: float) -> Column:
    """The risk of learning from positives and unlabelled rows, whose negative part isn't below 0; prior: the share of positives among unlabelled rows."""
    if not 0 < prior < 1:
        raise ValueError("prior must lie between 0 and 1")
    one, none = cross_entropy(logit, F.lit(1.0)), cross_entropy(logit, F.lit(0.0))
    negative = _mean(none, label == 1) - prior * _mean(none, label == 2)
    return prior * _mean(one, label == 2) + F.greatest(negative, F.lit(0.0))


def clean_negative(logit: Column, label: Column, weight: float = 1.0) -> Column:
    return weight * _mean(cross_entropy(logit, F.lit(0.0)), label == 0)


def smooth_l1(difference: Column, beta: float) -> Column:
    """Half the square over beta for small differences, the absolute difference less beta / 2 for others."""
    d = F.abs(difference)
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def span_loss(s: Column, e: Column, s_true: Column, e_true: Column, use: Column, beta: float = 0.1, iou_weight: float = 1.0) -> Column:
    """Smooth differences of both ends and 1 - IoU, over the rows whose span is used."""
    inter = F.greatest(F.least(e, e_true) - F.greatest(s, s_true), F.lit(0.0))
    union = F.greatest(e - s, F.lit(0.0)) + F.greatest(e_true - s_true, F.lit(0.0)) - inter
    iou = F.when(union > 0, inter / F.nullif(union, F.lit(0.0))).otherwise(0.0)
    return _mean(smooth_l1(s - s_true, beta), use) + _mean(smooth_l1(e - e_true, beta), use) + iou_weight * _mean(1 - iou, use)


def anchor_loss(mu: Column, sigma: Column, s_true: Column, e_true: Column, use: Column, weight_mu: float = 0.1, weight_sigma: float = 0.1, k: float = 2.0, beta: float = 0.2) -> Column:
    """How far the centre and the width of an anchor are from those of the true span."""
    centre, width = (s_true + e_true) / 2, (e_true - s_true) / (2 * k)
    return weight_mu * _mean(smooth_l1(mu - centre, beta), use) + weight_sigma * _mean(smooth_l1(sigma - width, beta), use)


def alignment_loss(attention: Column, target: Column, use: Column, eps: float = 1e-8) -> Column:
    """Kullback-Leibler divergence of the attention from a target distribution, mean over the rows that are used."""
    part = F.zip_with(target, attention, lambda t, a: F.when(t > 0, t * (F.log(t) - F.log(F.greatest(a, F.lit(eps))))).otherwise(0.0))
    return _mean(F.aggregate(part, F.lit(0.0), lambda x, y: x + y), use)
