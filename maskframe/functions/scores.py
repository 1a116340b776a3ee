"""Score and loss expressions: panoptic quality, Dice, cross-entropy, sigmoid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _share(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def pq(iou_sum: Column, tp: Column, fp: Column, fn: Column) -> Column:
    return _share(iou_sum, tp + 0.5 * fp + 0.5 * fn, 0.0)


def sq(iou_sum: Column, tp: Column) -> Column:
    return _share(iou_sum, tp, 0.0)


def rq(tp: Column, fp: Column, fn: Column) -> Column:
    return _share(tp, tp + 0.5 * fp + 0.5 * fn, 0.0)


def positive(target: Column) -> Column:
    """A soft target as 0 or 1: a half counts, so one of two raters is enough; null is 0."""
    return F.when(target >= 0.5, 1).otherwise(0)


def pooled_dice(pred: Column, target: Column) -> Column:
    """An aggregate: Dice of the places where probability and soft target reach a half."""
    p, t = positive(pred), positive(target)
    return dice(F.coalesce(F.sum(p * t), F.lit(0)), F.coalesce(F.sum(p + t), F.lit(0)))


def dice(both: Column, total: Column) -> Column:
    """Pooled Dice of an intersection and the sum of both areas; 1 where both are empty."""
    return _share(2.0 * both, total, 1.0)


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def soft_dice_loss(p: Column, t: Column, eps: float = 1.0) -> Column:
    """An aggregate: 1 - (2 sum(pt) + eps) / (sum(p) + sum(t) + eps)."""
    return 1 - (2 * F.sum(p * t) + eps) / (F.sum(p) + F.sum(t) + eps)


def bce_with_logits(z: Column, t: Column, pos_weight: float = 3.0) -> Column:
    """Weighted binary cross-entropy of one logit, in the form that doesn't overflow."""
    softplus = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
    return (1 - t) * z + (1 + (pos_weight - 1) * t) * softplus


def bce_dice_loss(z: Column, t: Column, pos_weight: float = 3.0, dice_weight: float = 1.0) -> Column:
    """An aggregate over pixels: mean cross-entropy plus weighted soft Dice loss of the sigmoid."""
    return F.avg(bce_with_logits(z, t, pos_weight)) + dice_weight * soft_dice_loss(sigmoid(z), t)
