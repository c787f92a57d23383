"""From model scores to a verification report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flareframe.functions import decode as D
from flareframe.operators import curves as C
from flareframe.operators import expected as X
from flareframe.operators import metrics as M
from flareframe.session import materialise


def verify(df: DataFrame, logits: str, y: str, labels: Sequence[str], threshold: float | None = None,
           ticks: int = 1001) -> DataFrame:
    """(metric, value) report of single-label logits: scores of the predicted class,
    expected TSS, and for two classes the best thresholds and the Brier score.

    One or two logits are binary (``threshold`` on P(positive)); more are multiclass.
    """
    k = len(labels)
    x = F.col(logits).cast("array<double>")
    if k == 2:
        p = F.when(F.size(x) == 1, D.sigmoid(F.get(x, F.lit(0)))).otherwise(F.get(D.softmax(x), F.lit(1)))
        probs = F.array(1.0 - F.col("p"), F.col("p"))
        d = df.select(F.col(y).alias("y"), p.alias("p")).withColumn("probs", probs)
        d = d.withColumn("yhat", D.two_class(F.col("probs"), 0.5 if threshold is None else threshold))
    else:
        d = df.select(F.col(y).alias("y"), D.softmax(x).alias("probs"))
        d = d.withColumn("yhat", D.argmax(F.col("probs")))
    out = M.summary_metrics(d, "y", "yhat", k)
    expected = materialise(X.expected_confusion(d, "probs", "y"))       # one row per class
    for mode in ("average", "weighted"):
        e = X.class_mean(expected, "tss", mode).withColumnRenamed("score", f"tss_expected_{mode}")
        out = out.unionByName(M.melt(e))
    if k == 2:
        out = out.unionByName(M.melt(M.brier_skill(d, "p", "y")))
        best = C.best_thresholds(materialise(C.threshold_curves(d, "p", "y", ticks)))
        out = out.unionByName(best.select(F.explode(F.array(*[
            F.struct(F.concat_ws("_", F.lit(c), F.lit("at_best"), "criterion").alias("metric"),
                     F.col(c).alias("value")) for c in ("threshold", "tss", "f1", "mcc")])).alias("x")).select("x.*"))
    return out
