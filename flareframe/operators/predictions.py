"""Assembling and scoring prediction tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flareframe.functions import decode as D


def decode(df: DataFrame, logits: str, kind: str = "multi", threshold: float = 0.5,
           labels: Sequence[str] = ("NONE", "C", "M", "X")) -> DataFrame:
    """Add ``label_pred`` and ``prob_pred`` (and ``probs_all``, ``ge_scores`` if ordinal).

    ``binary`` takes one logit, or two with the threshold on P(positive);
    ``multi`` the most probable class; ``multilabel`` every label reaching the
    threshold (array columns); ``ordinal`` the most probable class of K-1
    cumulative logits.
    """
    x = F.col(logits).cast("array<double>")
    if kind == "multilabel":
        p = F.transform(x, D.sigmoid)
        on = F.filter(F.transform(p, lambda v, i: F.struct(i.alias("i"), v.alias("p"))),
                      lambda z: z["p"] >= threshold)
        return df.withColumn("__on", on).withColumns({
            "label_pred": F.transform("__on", lambda z: D.name_of(z["i"], labels)),
            "prob_pred": F.transform("__on", lambda z: z["p"])}).drop("__on")
    if kind == "binary":
        pos = F.when(F.size(x) == 1, D.sigmoid(F.get(x, F.lit(0)))) \
            .otherwise(F.get(D.softmax(x), F.lit(1)))
        d = df.withColumn("__p", pos).withColumn("__c", D.binary_class(F.col("__p"), threshold))
        return d.withColumns({
            "label_pred": D.name_of(F.col("__c"), labels),
            "prob_pred": F.when(F.col("__c") == 1, F.col("__p")).otherwise(1.0 - F.col("__p"))
        }).drop("__p", "__c")
    if kind == "ordinal":
        d = df.withColumn("probs_all", D.ordinal_probs(x)) \
            .withColumn("ge_scores", F.transform(x, D.sigmoid))
        return d.withColumns({"label_pred": D.name_of(D.argmax(F.col("probs_all")), labels),
                              "prob_pred": F.array_max("probs_all")})
    if kind != "multi":
        raise ValueError("kind is 'multi', 'binary', 'multilabel' or 'ordinal'")
    d = df.withColumn("__p", D.softmax(x))
    return d.withColumns({"label_pred": D.name_of(D.argmax(x), labels),
                          "prob_pred": F.array_max("__p")}).drop("__p")


def score_with(df: DataFrame, fn: Callable[..., pd.DataFrame], schema: str, setup: Callable[[], object] | None = None,
               profile: ResourceProfile | None = None) -> DataFrame:
    """Run a user model over the rows in Arrow batches: ``fn`` maps a pandas frame of rows to one of ``schema``.

    With ``setup`` (load a model, open a device) its result is the second argument of ``fn``; it is called once a
    task, before the first batch, and not at all in tasks without rows.  ``profile`` names the resources, such as
    accelerators or memory, that the scoring tasks need.
    """
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        more = None
        for pdf in it:
            if setup is not None and more is None:
                more = (setup(),)
            yield fn(pdf, *(more or ()))
    return df.mapInPandas(batches, schema, profile=profile) if profile else df.mapInPandas(batches, schema)
