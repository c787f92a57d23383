"""Scores of probabilities without a threshold: expected confusion and losses."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flareframe.functions import decode as D
from flareframe.functions import scores as S

SCORES = ("accuracy", "precision", "recall", "specificity", "f1", "tss", "csi", "hss1", "hss2")


def prior_cdf(p: Column, prior: str, mu: Column, delta: Column) -> Column:
    """P(threshold <= p) under a uniform or a raised-cosine threshold prior."""
    if prior == "uniform":
        return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    if prior != "cosine":
        raise ValueError("prior is 'uniform' or 'cosine'")
    z = (p - mu) / delta
    mid = 0.5 * (1.0 + z + F.sin(F.lit(math.pi) * z) / math.pi)
    out = F.when(p > mu + delta, 1.0).when(p < mu - delta, 0.0).otherwise(mid)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def _per_class(value: float | Sequence[float], j: Column) -> Column:
    if isinstance(value, (list, tuple)):
        return F.get(F.array(*[F.lit(float(v)) for v in value]), j)
    return F.lit(float(value))


def expected_confusion(df: DataFrame, probs: str, y: str, by: Sequence[str] = (),
                       prior: str = "uniform", mu: float | Sequence[float] = 0.5,
                       delta: float | Sequence[float] = 0.1) -> DataFrame:
    """Expected tp, fp, fn, tn per class when the threshold is drawn from the prior.

    A one-element ``probs`` is P(positive) of a binary task.
    """
    p = F.col(probs).cast("array<double>")
    binary = F.size(p) == 1
    d = df.select(*by, F.col(y).alias("__y"), binary.alias("__b"),
                  F.posexplode(p).alias("cls", "__p"))
    hit = F.when(F.col("__b"), F.col("__y") == 1).otherwise(F.col("__y") == F.col("cls"))
    o = hit.cast("double")
    f = prior_cdf(F.col("__p"), prior, _per_class(mu, F.col("cls")), _per_class(delta, F.col("cls")))
    return d.groupBy(*by, "cls").agg(
        F.sum(o * f).alias("tp"), F.sum((1 - o) * f).alias("fp"),
        F.sum(o * (1 - f)).alias("fn"), F.sum((1 - o) * (1 - f)).alias("tn"),
        F.greatest(F.sum(1 - o), F.lit(1.0)).alias("negatives"))


def score_of(score: str, eps: float = 1e-12) -> Column:
    """A score of the columns tp, fp, fn, tn; guarded ratios are 0 on a zero denominator."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def safe(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / (b + eps)).otherwise(F.lit(0.0))

    prec, rec = S.ratio(tp, tp + fp), S.ratio(tp, tp + fn)
    table = {"accuracy": safe(tp + tn, tp + fp + fn + tn), "precision": safe(tp, tp + fp),
             "recall": safe(tp, tp + fn), "specificity": safe(tn, tn + fp),
             "f1": S.f1(prec, rec), "tss": safe(tp, tp + fn) + safe(tn, tn + fp) - 1.0,
             "csi": S.ratio(tp, tp + fp + fn), "hss1": S.ratio(tp - fp, tp + fn),
             "hss2": S.hss(tp, fp, fn, tn)}
    if score not in table:
        raise ValueError(f"score is one of {SCORES}")
    return table[score]


def expected_score(df: DataFrame, probs: str, y: str, score: str = "tss",
                   prior: str = "uniform", mu: float | Sequence[float] = 0.5,
                   delta: float | Sequence[float] = 0.1, mode: str = "average",
                   by: Sequence[str] = (), add_constant: bool = False) -> DataFrame:
    """Expected score averaged over classes (or weighted by their negatives), and the
    loss -score (+1 with ``add_constant``)."""
    c = expected_confusion(df, probs, y, by, prior, mu, delta)
    return class_mean(c, score, mode, by).withColumn(
        "loss", -F.col("score") + (1.0 if add_constant else 0.0))


def class_mean(counts: DataFrame, score: str, mode: str = "average",
               by: Sequence[str] = ()) -> DataFrame:
    """Mean over classes of a score of expected counts, plain or weighted by negatives."""
    if mode not in ("average", "weighted"):
        raise ValueError("mode is 'average' or 'weighted'")
    c = counts.withColumn("__s", score_of(score))
    val = (F.avg("__s") if mode == "average"
           else F.sum(F.col("__s") * F.col("negatives")) / F.sum("negatives"))
    return c.groupBy(*by).agg(val.alias("score"))


def chunked_expected_score(df: DataFrame, order: str, chunk: int, probs: str, y: str,
                           score: str = "tss", add_constant: bool = False) -> DataFrame:
    """Mean of the losses of consecutive chunks of ``chunk`` rows in ``order``."""
    from flareframe.operators.ordered import number_rows, with_quantile_segment
    d = with_quantile_segment(df.select(order, probs, y), order)
    d = number_rows(d, [], [order], F.col("__qseg"), "__rn")
    d = d.withColumn("chunk", F.floor((F.col("__rn") - 1) / chunk))
    return expected_score(d, probs, y, score, by=["chunk"], add_constant=add_constant) \
        .agg(F.avg("loss").alias("loss"))


def focal_score(df: DataFrame, logits: str, y: str, gamma: float = 2.0,
                alpha: float | Sequence[float] | None = None) -> DataFrame:
    """Mean multiclass focal loss; ``alpha`` none, one value or one per class."""
    log_pt = F.get(D.log_softmax(F.col(logits).cast("array<double>")), F.col(y).cast("int"))
    a = F.lit(1.0) if alpha is None else _per_class(alpha, F.col(y).cast("int"))
    d = df.select(log_pt.alias("__l"), a.alias("__a"))
    focus = F.pow(F.greatest(1.0 - F.exp("__l"), F.lit(1e-8)), F.lit(float(gamma)))
    return d.agg(F.avg(-F.col("__a") * focus * F.col("__l")).alias("loss"))


def focal_score_multilabel(df: DataFrame, logits: str, y: str, gamma: float = 2.0,
                           pos_weight: Sequence[float] | None = None) -> DataFrame:
    """Mean multilabel focal loss on 0/1 label arrays (gamma 0: weighted cross-entropy)."""
    d = df.select(F.posexplode(F.arrays_zip(F.col(logits).cast("array<double>").alias("x"),
                                            F.col(y).alias("t"))).alias("j", "z")) \
        .select("j", F.col("z.x").alias("x"), F.col("z.t").cast("double").alias("t"))
    w = F.lit(1.0) if pos_weight is None else _per_class(list(pos_weight), F.col("j"))

    def log_sigmoid(x: Column) -> Column:
        return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))

    x, t = F.col("x"), F.col("t")
    bce = -(w * t * log_sigmoid(x) + (1.0 - t) * log_sigmoid(-x))
    pt = F.when(t == 1, D.sigmoid(x)).otherwise(1.0 - D.sigmoid(x))
    focus = F.pow(F.greatest(1.0 - pt, F.lit(1e-8)), F.lit(float(gamma)))
    return d.agg(F.avg(focus * bce).alias("loss"))


def cross_entropy(df: DataFrame, logits: str, y: str,
                  weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted mean negative log-likelihood."""
    nll = -F.get(D.log_softmax(F.col(logits).cast("array<double>")), F.col(y).cast("int"))
    w = F.lit(1.0) if weights is None else _per_class(list(weights), F.col(y).cast("int"))
    return df.select(nll.alias("__n"), w.alias("__w")).agg(
        (F.sum(F.col("__w") * F.col("__n")) / F.sum("__w")).alias("loss"))
