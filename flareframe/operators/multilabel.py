"""Multilabel and ordinal metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flareframe.functions import decode as D
from flareframe.functions import scores as S
from flareframe.operators import curves as C
from flareframe.operators import metrics as M
from flareframe.session import materialise


def hamming_score(df: DataFrame, y: str, yhat: str, empty_as_one: bool = True) -> DataFrame:
    """Mean overlap (intersection / union) of 0/1 label arrays.

    Two empty sets count 1, or are left out with ``empty_as_one=False``.
    """
    z = F.arrays_zip(F.col(y).alias("a"), F.col(yhat).alias("b"))
    both = F.size(F.filter(z, lambda x: (x["a"] == 1) & (x["b"] == 1)))
    either = F.size(F.filter(z, lambda x: (x["a"] == 1) | (x["b"] == 1)))
    v = S.ratio(both, either)
    if empty_as_one:
        v = F.when(either == 0, F.lit(1.0)).otherwise(v)
    return df.agg(F.avg(v).alias("hamming_score"))


def label_counts(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """tp, fp, fn, tn, support per label position."""
    d = df.select(F.posexplode(F.arrays_zip(F.col(y).alias("a"), F.col(yhat).alias("b")))
                  .alias("cls", "z"))
    a, b = F.col("z.a") == 1, F.col("z.b") == 1
    return d.groupBy("cls").agg(*[F.count_if(c).cast("double").alias(n) for n, c in (
        ("tp", a & b), ("fp", ~a & b), ("fn", a & ~b), ("tn", ~a & ~b), ("support", a))])


def multilabel_metrics(df: DataFrame, y: str, logits: str, threshold: float = 0.5) -> DataFrame:
    """(metric, value) rows: subset accuracy, weighted precision, recall, F1, micro F1,
    Hamming loss and score, micro AUC of the hard predictions, accuracy per label."""
    d = df.select(F.col(y).cast("array<int>").alias("y"), D.multilabel_flags(
        F.col(logits).cast("array<double>"), threshold).alias("yhat"))
    rows = d.agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("accuracy"))
    lc = materialise(label_counts(d, "y", "yhat"))      # one row per label
    p = M.per_class_f1(lc)
    w = F.col("support")
    tp, fp, fn, tn = (F.sum(c) for c in ("tp", "fp", "fn", "tn"))

    def mean(c: str) -> Column:
        return F.coalesce(S.ratio(F.sum(F.col(c) * w), F.sum(w)), F.lit(0.0))

    agg = p.agg(mean("precision").alias("precision"), mean("recall").alias("recall"),
                mean("f1").alias("f1score"),
                F.coalesce(S.ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1score_micro"),
                S.ratio(fp + fn, tp + fp + fn + tn).alias("h_loss"),
                ((S.ratio(tp, tp + fn) + S.ratio(tn, tn + fp)) / 2).alias("roc_auc"))
    per = lc.select(F.concat_ws("_", F.lit("accuracy_class"), "cls").alias("metric"),
                    S.ratio(F.col("tp") + F.col("tn"),
                            F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("value"))
    return (M.melt(rows).unionByName(M.melt(agg))
            .unionByName(M.melt(hamming_score(d, "y", "yhat"), rename={"hamming_score": "h_score"}))
            .unionByName(per))


def monotonicity(df: DataFrame, logits: str) -> DataFrame:
    """Share of rows whose cumulative probabilities rise somewhere, and the mean rise."""
    p = D.exceedance(F.col(logits).cast("array<double>"), monotone=False)
    d = df.select(p.alias("p")).withColumn("d", F.transform(
        F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p", i) - F.get("p", i - 1)))
    rise = F.aggregate("d", F.lit(0.0), lambda acc, x: acc + F.greatest(x, F.lit(0.0)))
    return d.agg(F.avg(F.exists("d", lambda x: x > 0).cast("double")).alias("mvr"),
                 (F.sum(rise) / F.sum(F.size("d"))).alias("mvm"))


def class_index(y: Column, dtype: str) -> Column:
    """Ordinal target given as class index or as cumulative flags."""
    if dtype.startswith("array"):
        return F.aggregate(y, F.lit(0), lambda acc, x: acc + x.cast("int"))
    return y.cast("int")


def boundary_scores(df: DataFrame, y: str, logits: str) -> DataFrame:
    """ROC-AUC and average precision of every boundary task [class >= k]."""
    p = D.exceedance(F.col(logits).cast("array<double>"), monotone=False)
    d = df.select(F.col(y).alias("__y"), F.posexplode(p).alias("__j", "p")) \
        .withColumn("threshold", F.col("__j") + 1) \
        .withColumn("hit", (F.col("__y") >= F.col("threshold")).cast("int"))
    return C.ranking_scores(d, "p", "hit", ["threshold"])


def ordinal_metrics(df: DataFrame, y: str, logits: str, k: int,
                    thresholds: Sequence[float] | None = None) -> DataFrame:
    """(metric, value) rows of an ordinal model: the single-label report of its most
    probable class, plus quadratic kappa, boundary AUC/AP and monotonicity."""
    x = F.col(logits).cast("array<double>")
    d = df.select(class_index(F.col(y), dict(df.dtypes)[y]).alias("y"), x.alias("x"))
    d = d.withColumn("yhat", D.argmax(D.ordinal_probs(F.col("x"), monotone=False))) \
        .withColumn("yord", D.ordinal_class(F.col("x"), thresholds))
    base = M.summary_metrics(d, "y", "yhat", k)
    kappa = M.melt(M.quadratic_kappa(M.confusion(d, "y", "yord", k)))
    b = boundary_scores(d, "y", "x")
    per = b.select(F.explode(F.array(*[F.struct(
        F.concat_ws("_", F.lit(n), "threshold").alias("metric"), F.col(n).alias("value"))
        for n in ("auc", "ap")])).alias("x")).select("x.*")
    mono = M.melt(monotonicity(d, "x"))
    return base.unionByName(kappa).unionByName(per).unionByName(mono)
