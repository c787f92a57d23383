"""Threshold curves and ranking scores of binary probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flareframe.functions import scores as S
from flareframe.operators.ordered import running, whole, with_quantile_segment

CURVE = ["precision", "recall", "f1", "tss", "hss", "mcc", "apss"]


def tick_value(i: Column, ticks: int) -> Column:
    """Threshold i of ``ticks`` evenly spaced ones on [0, 1], the last exactly 1."""
    return F.when(i == ticks - 1, F.lit(1.0)).otherwise(i * F.lit(1.0 / (ticks - 1)))


def tick_bucket(p: Column, ticks: int) -> Column:
    """Index of the highest tick <= p, -1 when there is none (null, NaN, p < 0)."""
    last = ticks - 1
    i = F.least(F.greatest(F.floor(p * last), F.lit(-1)), F.lit(last))
    # the product can be off by one ulp: compare with the neighbouring ticks
    i = F.when((i < last) & (p >= tick_value(i + 1, ticks)), i + 1) \
        .when((i >= 0) & (p < tick_value(i, ticks)), i - 1).otherwise(i)
    return F.when(p.isNull() | F.isnan(p) | (p < 0), F.lit(-1)).otherwise(i).cast("long")


def tick_counts(df: DataFrame, p: str, y: str, ticks: int = 1001,
                by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn of ``p >= threshold`` at every tick.

    Rows fall into their tick bucket and are counted there (map-side); reverse
    running sums over at most ``ticks`` rows per run do the rest.
    """
    pos = F.col(y).cast("long")
    b = df.groupBy(*by, tick_bucket(F.col(p).cast("double"), ticks).alias("tick")).agg(
        F.sum(pos).alias("__p"), F.sum(1 - pos).alias("__n"))
    spark = df.sparkSession
    grid = spark.range(-1, ticks).select(F.col("id").alias("tick"), F.lit(0).cast("long").alias("__p"),
                                         F.lit(0).cast("long").alias("__n"))
    if by:      # every run gets every tick: runs are few rows by then
        grid = b.select(*by).distinct().withColumn("tick", F.explode(F.sequence(
            F.lit(-1).cast("long"), F.lit(ticks - 1).cast("long")))) \
            .withColumns({"__p": F.lit(0).cast("long"), "__n": F.lit(0).cast("long")})
    full = b.unionByName(grid).groupBy(*by, "tick").agg(F.sum("__p").alias("__p"),
                                                        F.sum("__n").alias("__n"))
    part = Window.partitionBy(*by) if by else whole()
    up = part.orderBy(F.desc("tick")).rowsBetween(Window.unboundedPreceding, 0)
    c = full.withColumns({"tp": F.sum("__p").over(up).cast("double"),
                          "fp": F.sum("__n").over(up).cast("double"),
                          "__pt": F.sum("__p").over(part), "__nt": F.sum("__n").over(part)})
    return c.where("tick >= 0").select(
        *by, "tick", tick_value(F.col("tick"), ticks).alias("threshold"), "tp", "fp",
        (F.col("__pt") - F.col("tp")).alias("fn"), (F.col("__nt") - F.col("fp")).alias("tn"))


def threshold_curves(df: DataFrame, p: str, y: str, ticks: int = 1001, eps: float = 1e-12,
                     by: Sequence[str] = ()) -> DataFrame:
    """Counts and the seven scores at every threshold."""
    c = tick_counts(df, p, y, ticks, by)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"precision": S.ratio(tp, tp + fp, eps), "recall": S.ratio(tp, tp + fn, eps)})
    return c.withColumns({
        "f1": S.f1(F.col("precision"), F.col("recall"), eps),
        "tss": F.col("recall") + S.ratio(tn, tn + fp, eps) - 1.0,
        "hss": S.hss(tp, fp, fn, tn, eps), "mcc": S.mcc(tp, fp, fn, tn, eps),
        "apss": S.appleman(tp, fp, fn, tn, eps)})


def argmax_row(df: DataFrame, score: str | Column, order: str, by: Sequence[str] = ()) -> DataFrame:
    """The row with the highest score, the lowest ``order`` on ties (nulls and NaN skipped)."""
    s = F.col(score) if isinstance(score, str) else score
    s = F.when(s.isNotNull() & ~F.isnan(s), F.struct(s, -F.col(order)))
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), s).alias("__r")).select(*by, "__r.*")


def best_thresholds(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the best TSS, F1 and MCC and of the precision-recall crossing."""
    out = None
    for score in ("tss", "f1", "mcc"):
        r = argmax_row(curves, score, "tick", by).withColumn("criterion", F.lit(score))
        out = r if out is None else out.unionByName(r)
    return out.unionByName(crossing(curves, by).withColumn("criterion", F.lit("precrec")))


def crossing(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Where precision and recall are closest with both above 0; best F1 if nowhere."""
    gap = F.when((F.col("precision") > 0) & (F.col("recall") > 0),
                 -F.abs(F.col("precision") - F.col("recall")))
    c = curves.withColumn("__ok", F.max(gap.isNotNull()).over(
        Window.partitionBy(*by) if by else whole()))
    score = F.when(F.col("__ok"), gap).otherwise(F.col("f1"))
    return argmax_row(c, score, "tick", by).drop("__ok")


def threshold_for(curves: DataFrame, precision: float | None = None,
                  recall: float | None = None, by: Sequence[str] = (),
                  highest: bool = True) -> DataFrame:
    """Highest (or lowest) threshold meeting both floors; null when none does."""
    ok = F.lit(True)
    if precision is not None:
        ok = ok & (F.col("precision") >= precision)
    if recall is not None:
        ok = ok & (F.col("recall") >= recall)
    pick = F.max if highest else F.min
    return curves.groupBy(*by).agg(pick(F.when(ok, F.col("threshold"))).alias("threshold"))


def best_tss(df: DataFrame, p: str, y: str, ticks: int = 101, eps: float = 1e-7) -> DataFrame:
    """Best TSS over ``ticks`` thresholds, its threshold, TPR and TNR."""
    c = tick_counts(df, p, y, ticks)
    tpr = S.ratio(F.col("tp"), F.col("tp") + F.col("fn"), eps)
    tnr = S.ratio(F.col("tn"), F.col("tn") + F.col("fp"), eps)
    c = c.withColumns({"tpr": tpr, "tnr": tnr}).withColumn("tss", F.col("tpr") + F.col("tnr") - 1.0)
    return argmax_row(c, "tss", "tick").select("tss", "threshold", "tpr", "tnr")


def _ranked(df: DataFrame, p: str, y: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score, descending: positives and negatives here and up to here."""
    pos = F.col(y).cast("long")
    d = df.where(F.col(p).isNotNull()).groupBy(*by, (-F.col(p)).alias("__s")).agg(
        F.sum(pos).alias("t"), F.sum(1 - pos).alias("f"))
    d = with_quantile_segment(d, "__s")
    return running(d, by, ["__s"], F.col("__qseg"), ct=("sum", F.col("t")), cf=("sum", F.col("f")))


def ranking_scores(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC area (ties counted half; null with a single class) and average precision
    (sum of recall steps times precision) from one ranking."""
    d = _ranked(df, p, y, by)
    area = F.sum(F.col("f") * (F.col("ct") - F.col("t") / 2.0))
    both = F.sum("t").cast("double") * F.sum("f").cast("double")
    ap = F.sum(F.col("t") * (F.col("ct") / (F.col("ct") + F.col("cf"))))
    return d.groupBy(*by).agg(F.try_divide(area, both).alias("auc"),
                              F.try_divide(ap, F.sum("t").cast("double")).alias("ap"))


def roc_auc(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return ranking_scores(df, p, y, by).select(*by, "auc")


def average_precision(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return ranking_scores(df, p, y, by).select(*by, "ap")


def interp_to_grid(curves: DataFrame, run: str, x: str, ys: Sequence[str],
                   ticks: int = 1001) -> DataFrame:
    """Every run's curve at the ticks of a common grid, linear between knots and held
    constant beyond the ends.

    Knots and grid points merge into one line per run (both are curve sized),
    and each grid point looks at the knot before and after it.
    """
    knots = curves.select(run, F.col(x).cast("double").alias("__x"), F.lit(1).alias("__k"),
                          F.struct(F.col(x).cast("double").alias("x"), *[
                              F.col(c).cast("double").alias(c) for c in ys]).alias("__v"))
    grid = curves.select(run).distinct().withColumn("tick", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(ticks - 1).cast("long")))) \
        .withColumn("__x", tick_value(F.col("tick"), ticks)).withColumn("__k", F.lit(2))
    line = knots.unionByName(grid, allowMissingColumns=True)
    # numpy-style: a grid point on a knot takes that knot
    part = Window.partitionBy(run)
    lo = F.last("__v", ignorenulls=True).over(
        part.orderBy("__x", "__k").rowsBetween(Window.unboundedPreceding, 0))
    hi = F.last("__v", ignorenulls=True).over(
        part.orderBy(F.desc("__x"), F.desc("__k")).rowsBetween(Window.unboundedPreceding, -1))
    line = line.withColumns({"__lo": lo, "__hi": hi}).where("__k = 2")
    a, b = F.col("__lo"), F.col("__hi")
    span = F.nullif(b["x"] - a["x"], F.lit(0.0))
    return line.select(run, "tick", F.col("__x").alias("threshold"), *[
        F.coalesce((b[c] - a[c]) / span * (F.col("__x") - a["x"]) + a[c], a[c], b[c]).alias(c)
        for c in ys])


def consensus_threshold(curves: DataFrame, run: str = "run", min_recall: float | None = None,
                        min_precision: float | None = None, penalty: float = 0.0,
                        weights: DataFrame | None = None, ticks: int = 1001) -> DataFrame:
    """One threshold for several runs: highest (mean TSS - penalty * std) among the
    thresholds meeting the floors on the means (all of them if none does), with the
    mean and spread of every score there.  ``weights`` has (run, weight)."""
    g = interp_to_grid(curves, run, "threshold", CURVE, ticks)
    if weights is None:
        g = g.withColumn("__w", F.lit(1.0))
    else:
        g = g.join(weights.select(run, F.col("weight").cast("double").alias("__w")), run)
    m = g.groupBy("tick", "threshold").agg(
        *[(F.sum(F.col(c) * F.col("__w")) / F.sum("__w")).alias(f"mean_{c}") for c in CURVE],
        *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"std_{c}") for c in CURVE])
    ok = F.lit(True)
    if min_recall is not None:
        ok = ok & (F.col("mean_recall") >= min_recall)
    if min_precision is not None:
        ok = ok & (F.col("mean_precision") >= min_precision)
    m = m.withColumn("__ok", ok).withColumn("__any", F.max("__ok").over(whole()))
    score = F.when(F.col("__ok") | ~F.col("__any"), F.col("mean_tss") - penalty * F.col("std_tss"))
    return argmax_row(m, score, "tick").drop("__ok", "__any", "tick") \
        .withColumnRenamed("threshold", "tau")
