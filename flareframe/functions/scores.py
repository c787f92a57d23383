"""Skill-score arithmetic on TP, FP, FN, TN columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, eps: float = 0.0) -> Column:
    """num / (den + eps); null on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double") + F.lit(float(eps)))


def f1(p: Column, r: Column, eps: float = 0.0) -> Column:
    return 2.0 * ratio(p * r, p + r, eps)


def hss(tp: Column, fp: Column, fn: Column, tn: Column, eps: float = 0.0) -> Column:
    return ratio(2.0 * (tp * tn - fp * fn), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn), eps)


def gss(tp: Column, fp: Column, fn: Column, tn: Column, eps: float = 0.0) -> Column:
    chance = ratio((tp + fn) * (tp + fp), tp + fp + fn + tn, eps)
    return ratio(tp - chance, tp + fp + fn - chance, eps)


def mcc(tp: Column, fp: Column, fn: Column, tn: Column, eps: float = 1e-12) -> Column:
    return ratio(tp * tn - fp * fn,
                 F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) + F.lit(eps)))


def appleman(tp: Column, fp: Column, fn: Column, tn: Column, eps: float = 1e-12) -> Column:
    """Gain over always forecasting the more frequent outcome."""
    n = F.greatest(tp + fp + fn + tn, F.lit(eps))
    base = F.greatest(tp + fn, fp + tn) / n
    return ((tp + tn) / n - base) / F.greatest(1.0 - base, F.lit(eps))


def brier_skill(mse: Column, mean: Column, eps: float = 1e-12) -> Column:
    """1 - MSE / climatology; on a constant outcome 1 if perfect, else 0."""
    ref = mean * (1.0 - mean)
    return (F.when((ref < eps) & (mse < eps), 1.0).when(ref < eps, 0.0)
            .otherwise(1.0 - mse / F.nullif(ref, F.lit(0.0))))


def rates(eps: float = 1e-12) -> dict[str, Column]:
    """TPR and TNR with eps; PPV, NPV, FPR, FNR, FDR, ACC null on zero denominators."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return {"tpr": ratio(tp, tp + fn, eps), "tnr": ratio(tn, tn + fp, eps),
            "ppv": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn),
            "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, tp + fn),
            "fdr": ratio(fp, tp + fp), "acc": ratio(tp + tn, tp + fp + fn + tn)}
