"""Class and sample weights from class counts.

Every function reduces the rows to K counts first; ``K`` is a parameter, so
the per-class tables, and the K-element array that carries weights back to
the rows without a join, are of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flareframe.operators.ordered import whole



def class_counts(df: DataFrame, y: str, k: int) -> DataFrame:
    """Count of every class 0..k-1, absent ones included."""
    n = df.groupBy(F.col(y).cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(k).select(F.col("id").alias("y"))
    return grid.join(n, "y", "left").select("y", F.coalesce("n", F.lit(0)).cast("double").alias("n"))


def class_weights(df: DataFrame, y: str, k: int, scheme: str = "balanced",
                  normalize: bool = True) -> DataFrame:
    """Weight per class: ``balanced`` n/(K c), ``inverse`` 1/c, ``inverse_v2`` max/c,
    optionally scaled to mean 1.  An empty class counts as one row."""
    c = class_counts(df, y, k)
    safe = F.greatest(F.col("n"), F.lit(1.0))
    if scheme == "inverse":
        w = 1.0 / safe
    elif scheme == "inverse_v2":
        w = F.max("n").over(whole()) / safe
    elif scheme == "balanced":
        w = F.sum("n").over(whole()) / (k * safe)
    else:
        raise ValueError("scheme is 'balanced', 'inverse' or 'inverse_v2'")
    c = c.withColumn("weight", w)
    if normalize:
        c = c.withColumn("weight", F.col("weight") * k / F.sum("weight").over(whole()))
    return c


def pos_weight(df: DataFrame, y: str, positive: int = 1, laplace: float = 1.0) -> DataFrame:
    """Binary positive weight (negatives + laplace) / (positives + laplace)."""
    pos = F.count_if(F.col(y) == positive)
    neg = F.count_if(F.col(y) != positive)
    return df.agg(pos.alias("n_pos"), neg.alias("n_neg")) \
        .withColumn("pos_weight", (F.col("n_neg") + laplace) / (F.col("n_pos") + laplace))


def ordinal_pos_weight(df: DataFrame, y: str, k: int, clip: float | None = None,
                       eps: float = 1e-12) -> DataFrame:
    """Per threshold t = 1..K-1: rows below / rows at or above."""
    c = class_counts(df, y, k)
    ge = F.sum("n").over(whole().orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("n_pos", ge).withColumn("n_neg", F.sum("n").over(whole()) - F.col("n_pos"))
    w = F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(eps))
    if clip is not None:
        w = F.least(w, F.lit(float(clip)))
    return c.where("y >= 1").select(F.col("y").alias("threshold"), "n_pos", "n_neg",
                                    w.alias("pos_weight"))


def focal_alpha(df: DataFrame, y: str, k: int, exponent: float = 0.5,
                cap: float = 10.0) -> DataFrame:
    """(1/frequency)^exponent scaled to mean 1, capped at ``cap`` medians, at least 1e-6."""
    c = class_counts(df, y, k)
    freq = F.least(F.greatest(F.col("n") / F.greatest(F.sum("n").over(whole()), F.lit(1.0)),
                              F.lit(1e-8)), F.lit(1.0))
    c = c.withColumn("__inv", F.pow(1.0 / freq, F.lit(float(exponent))))
    c = c.withColumn("__a", F.col("__inv") / F.avg("__inv").over(whole()))
    capped = F.least(F.col("__a"), F.median("__a").over(whole()) * cap)
    return c.select("y", "n", F.greatest(capped, F.lit(1e-6)).alias("alpha"))


def weight_array(table: DataFrame, weight: str = "weight") -> Column:
    """K-element array of per-class values as a scalar subquery."""
    return table.agg(F.transform(F.array_sort(F.collect_list(F.struct("y", weight))),
                                 lambda x: x[weight])).scalar()


def sample_weights(df: DataFrame, y: str, k: int, scheme: str = "balanced",
                   normalize: bool = True, name: str = "sample_weight") -> DataFrame:
    """Each row's class weight; ``y`` may be the target or the four-class id."""
    w = class_weights(df, y, k, scheme, normalize)
    return df.withColumn(name, F.get(weight_array(w), F.col(y).cast("int")))


def weight_summary(df: DataFrame, name: str = "sample_weight") -> DataFrame:
    return df.agg(F.min(name).alias("w_min"), F.max(name).alias("w_max"), F.avg(name).alias("w_mean"))
