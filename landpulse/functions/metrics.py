"""Scores derived from confusion counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landpulse.functions.core import as_col


def counts(predicted, reference) -> list[Column]:
    """tp, fp, fn, tn aggregates of two non-null boolean columns."""
    p, r = as_col(predicted), as_col(reference)
    return [F.count_if(p & r).alias("tp"), F.count_if(p & ~r).alias("fp"), F.count_if(~p & r).alias("fn"), F.count_if(~p & ~r).alias("tn")]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def scores(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, Column]:
    """Ratios with an empty denominator are 0. Specificity and prevalence come along, as F1
    alone says nothing without negatives."""
    tp, fp, fn, tn = (as_col(c).cast("double") for c in (tp, fp, fn, tn))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    specificity = _ratio(tn, tn + fp)
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return {"precision": precision, "recall": recall, "specificity": specificity, "npv": _ratio(tn, tn + fn),
            "f1": _ratio(2.0 * precision * recall, precision + recall), "balanced_accuracy": 0.5 * (recall + specificity),
            "iou": _ratio(tp, tp + fp + fn), "mcc": _ratio(tp * tn - fp * fn, spread),
            "area_bias": _ratio(tp + fp, tp + fn), "prevalence": _ratio(tp + fn, tp + fp + fn + tn)}


def kappa(tp="tp", fp="fp", fn="fn", tn="tn") -> Column:
    tp, fp, fn, tn = (as_col(c).cast("double") for c in (tp, fp, fn, tn))
    total = F.greatest(F.lit(1.0), tp + fp + fn + tn)
    observed = (tp + tn) / total
    expected = ((tp + fp) * (tp + fn) + (tn + fp) * (tn + fn)) / (total * total)
    return (observed - expected) / F.greatest(F.lit(1e-6), 1.0 - expected)


def evidence_tier(real, reproducible, independent, end_to_end) -> Column:
    real, rep, ind, e2e = (as_col(c) for c in (real, reproducible, independent, end_to_end))
    return (F.when(e2e & real & rep & ind, "END_TO_END_VALIDATED").when(ind & real & rep, "INDEPENDENT_REFERENCE_VALIDATED")
            .when(real & rep, "REAL_DATA_VALIDATED").when(rep, "INTERNAL_REPRODUCIBILITY").otherwise("NOT_VALIDATED"))


def accuracy_gate(balanced_accuracy, floor: float = 0.60) -> Column:
    return F.when(as_col(balanced_accuracy) >= floor, "candidate").otherwise("rejected")
