"""Forecast-verification metrics over prediction tables.

Everything starts from one map-side combined count per (true, predicted)
class; what follows works on at most K*K rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flareframe.functions import scores as S
from flareframe.functions.labels import lookup
from flareframe.operators.ordered import whole
from flareframe.session import materialise



def accuracy(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, y: str, yhat: str, k: int) -> DataFrame:
    """Counts for every (y, yhat) in 0..k-1, zeros included, and the row-normalised share."""
    n = df.groupBy(F.col(y).cast("long").alias("y"), F.col(yhat).cast("long").alias("yhat")) \
        .agg(F.count(F.lit(1)).alias("n"))
    cells = df.sparkSession.range(k * k).select(
        F.floor(F.col("id") / k).alias("y"), (F.col("id") % k).alias("yhat"))
    cm = cells.join(n, ["y", "yhat"], "left").select("y", "yhat", F.coalesce("n", F.lit(0)).alias("n"))
    support = F.sum("n").over(Window.partitionBy("y"))
    return cm.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), support), F.lit(0.0)))


def one_vs_rest(cm: DataFrame) -> DataFrame:
    """tp, fp, fn, tn and support per class (doubles) from a confusion table."""
    total = F.sum("n").over(whole())
    parts = cm.withColumn("__all", total).select("__all", F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("row"), F.lit(0).cast("long").alias("col"),
                 F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("diag")),
        F.struct(F.col("yhat").alias("cls"), F.lit(0).cast("long").alias("row"),
                 F.col("n").alias("col"), F.lit(0).cast("long").alias("diag")))).alias("x"))
    c = parts.groupBy("x.cls").agg(F.max("__all").cast("double").alias("__all"),
                                   *[F.sum(f"x.{f}").cast("double").alias(f"__{f}")
                                     for f in ("row", "col", "diag")])
    return c.select("cls", F.col("__diag").alias("tp"), (F.col("__col") - F.col("__diag")).alias("fp"),
                    (F.col("__row") - F.col("__diag")).alias("fn"),
                    (F.col("__all") - F.col("__row") - F.col("__col") + F.col("__diag")).alias("tn"),
                    F.col("__row").alias("support"))


def binary_counts(cm: DataFrame) -> DataFrame:
    """The positive class's tp, fp, fn, tn of a two-class confusion table."""
    return one_vs_rest(cm).where("cls = 1")


def skill_scores(counts: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Rates, TSS, HSS, GSS, MCC and Appleman score for rows with tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumns(S.rates(eps))
    return out.withColumns({
        "tss": F.col("tpr") + F.col("tnr") - 1.0, "hss": S.hss(tp, fp, fn, tn),
        "gss": S.gss(tp, fp, fn, tn), "mcc": S.mcc(tp, fp, fn, tn),
        "apss": S.appleman(tp, fp, fn, tn)})


def per_class_f1(ovr: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class, 0 on zero denominators."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return ovr.withColumns({"precision": F.coalesce(S.ratio(tp, tp + fp), F.lit(0.0)),
                            "recall": F.coalesce(S.ratio(tp, tp + fn), F.lit(0.0)),
                            "f1": F.coalesce(S.ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))})


def weighted_f1(cm: DataFrame) -> DataFrame:
    """Support-weighted precision, recall and F1, and micro and macro F1."""
    p = per_class_f1(one_vs_rest(cm))
    w = F.col("support")

    def mean(c: str) -> Column:
        return F.coalesce(S.ratio(F.sum(F.col(c) * w), F.sum(w)), F.lit(0.0))

    return p.agg(mean("precision").alias("precision"), mean("recall").alias("recall"),
                 mean("f1").alias("f1_weighted"),
                 F.coalesce(S.ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")),
                            F.lit(0.0)).alias("f1_micro"), F.avg("f1").alias("f1_macro"))


def classification_report(cm: DataFrame, names: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted rows."""
    p = per_class_f1(one_vs_rest(cm))
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("cls").cast("int"))
    rows = p.select(label.alias("name"), "precision", "recall", "f1", "support")
    w = F.col("support")
    macro = p.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
                  F.sum("support").alias("support"))
    weighted = p.agg(*[F.coalesce(S.ratio(F.sum(F.col(c) * w), F.sum(w)), F.lit(0.0)).alias(c)
                       for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return (rows.unionByName(macro.withColumn("name", F.lit("macro avg")))
            .unionByName(weighted.withColumn("name", F.lit("weighted avg"))))


def class_summary(per_class: DataFrame, cols: Sequence[str], eps: float = 1e-7) -> DataFrame:
    """Macro (nulls skipped) and support-weighted mean of per-class scores: one row per score."""
    share = F.col("support") / (F.sum("support").over(whole()) + eps)
    d = per_class.withColumn("__s", share)
    aggs = d.agg(*[F.struct(F.lit(c).alias("score"), F.avg(c).alias("macro"),
                            F.sum(F.col(c) * F.col("__s")).alias("weighted")).alias(c) for c in cols])
    return aggs.select(F.explode(F.array(*cols)).alias("x")).select("x.*")


def micro_scores(cm: DataFrame, eps: float = 1e-7) -> DataFrame:
    """Counts summed over classes, and the scores of the totals."""
    t = one_vs_rest(cm).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    t = t.withColumn("n", tp + fp + fn + tn).withColumns({
        "tpr": S.ratio(tp, tp + fn, eps), "tnr": S.ratio(tn, tn + fp, eps),
        "ppv": S.ratio(tp, tp + fp, eps), "npv": S.ratio(tn, tn + fn, eps),
        "fpr": S.ratio(fp, fp + tn, eps), "fnr": S.ratio(fn, tp + fn, eps),
        "fdr": S.ratio(fp, tp + fp, eps)})
    return t.withColumns({"tss": F.col("tpr") + F.col("tnr") - 1.0,
                          "hss": S.hss(tp, fp, fn, tn, eps), "gss": S.gss(tp, fp, fn, tn, eps),
                          "accuracy": S.ratio(tp + tn, F.col("n"), eps)})


def multiclass_mcc(cm: DataFrame) -> DataFrame:
    """Multiclass correlation R_K from the confusion table, 0 on a zero denominator."""
    o = one_vs_rest(cm).withColumn("p", F.col("tp") + F.col("fp"))
    a = o.agg(F.sum("tp").alias("c"), F.sum("support").alias("s"),
              F.sum(F.col("p") * F.col("support")).alias("pt"),
              F.sum(F.col("p") * F.col("p")).alias("pp"),
              F.sum(F.col("support") * F.col("support")).alias("tt"))
    s2 = F.col("s") * F.col("s")
    den = F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt")))
    return a.select(F.coalesce(S.ratio(F.col("c") * F.col("s") - F.col("pt"), den), F.lit(0.0))
                    .alias("mcc"))


def brier_skill(df: DataFrame, p: str, y: str, eps: float = 1e-12) -> DataFrame:
    o = F.col(y).cast("double")
    a = df.agg(F.avg((F.col(p) - o) * (F.col(p) - o)).alias("__mse"), F.avg(o).alias("__mean"))
    return a.select(S.brier_skill(F.col("__mse"), F.col("__mean"), eps).alias("bss"))


def binary_class_scores(counts: DataFrame, eps: float = 1e-12) -> DataFrame:
    """F1 and TSS of the positive and of the negative class."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def one(tp: Column, fp: Column, fn: Column) -> Column:
        return S.f1(S.ratio(tp, tp + fp, eps), S.ratio(tp, tp + fn, eps), eps)

    tss = S.ratio(tp, tp + fn, eps) + S.ratio(tn, tn + fp, eps) - 1.0
    return counts.select(one(tp, fp, fn).alias("f1_pos"), one(tn, fn, fp).alias("f1_neg"),
                         tss.alias("tss_pos"), tss.alias("tss_neg"))


def quadratic_kappa(cm: DataFrame) -> DataFrame:
    """Agreement weighted by squared class distance."""
    w = Window.partitionBy("y")
    v = Window.partitionBy("yhat")
    d = cm.withColumn("__r", F.sum("n").over(w)).withColumn("__c", F.sum("n").over(v)) \
        .withColumn("__w", F.pow(F.col("y") - F.col("yhat"), 2).cast("double"))
    a = d.agg(F.sum(F.col("__w") * F.col("n")).alias("o"),
              (F.sum(F.col("__w") * F.col("__r") * F.col("__c")) / F.sum("n")).alias("e"))
    return a.select((1.0 - S.ratio(F.col("o"), F.col("e"))).alias("qwk"))


def summary_metrics(df: DataFrame, y: str, yhat: str, k: int, eps: float = 1e-12) -> DataFrame:
    """Flat report: one (metric, value) row per score of a single-label prediction table.

    Two classes give the positive class's scores; more give per-class means
    (macro, weighted) and micro scores.
    """
    cm = materialise(confusion(df, y, yhat, k))     # K*K rows: the data is read once
    sc = skill_scores(one_vs_rest(cm), eps)
    acc = cm.agg((F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0))
                  / F.nullif(F.sum("n"), F.lit(0))).alias("accuracy"))
    parts = [melt(acc), melt(weighted_f1(cm)), melt(multiclass_mcc(cm), rename={"mcc": "mcc_rk"})]
    if k == 2:
        pos = sc.where("cls = 1").drop("cls", "support")
        parts += [melt(pos), melt(binary_class_scores(binary_counts(cm), eps))]
    else:
        s = class_summary(sc, ["tpr", "tnr", "tss", "hss", "gss"])
        parts += [s.select(F.concat_ws("_", "score", F.lit(m)).alias("metric"),
                           F.col(m).alias("value")) for m in ("macro", "weighted")]
        parts.append(melt(micro_scores(cm), suffix="_micro"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def melt(one_row: DataFrame, suffix: str = "", rename: dict[str, str] | None = None) -> DataFrame:
    """A one-row table of scores as (metric, value) rows."""
    names = rename or {}
    return one_row.select(F.explode(F.array(*[
        F.struct(F.lit(names.get(c, c) + suffix).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in one_row.columns])).alias("x")).select("x.*")


def prediction_report(df: DataFrame, label: str = "label", pred: str = "label_pred",
                      scheme: str = "multi", threshold: str | None = None,
                      eps: float = 1e-7) -> DataFrame:
    """Offline report of a prediction table with class names, under four-class or binary
    labels; both spellings (M and M+) are accepted."""
    from flareframe.functions.labels import label_maps
    maps = label_maps(scheme, threshold)
    ids = {c: maps["label2id"][n] for c, n in maps["label"].items()} | maps["label2id"]
    d = df.select(lookup(ids, F.col(label)).alias("y"), lookup(ids, F.col(pred)).alias("yhat"))
    return summary_metrics(d, "y", "yhat", len(maps["label2id"]), eps)


