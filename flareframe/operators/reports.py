"""Data-quality reports: counts per reason, agreement, distributions, across-run statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flareframe.functions.labels import agreement_letter


def first_reason(rules: Sequence[tuple[str, Column]], otherwise: str = "ok") -> Column:
    """Name of the first rule that holds, in order."""
    out = F.lit(otherwise)
    for name, cond in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def reason_counts(df: DataFrame, reason: str = "reason", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))


def only_matched(df: DataFrame, error: str) -> DataFrame:
    return df.where(F.col(error).isNull())


def label_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often label ``a`` (any spelling) equals class ``b``, differs, or is missing."""
    x = agreement_letter(F.col(a))
    return df.agg(F.count_if(x == F.col(b)).alias("n_equal"), F.count_if(x != F.col(b)).alias("n_diff"),
                  F.count_if(x.isNull()).alias("n_missing"))


def class_counts(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def ordered_counts(df: DataFrame, label: str) -> DataFrame:
    """Labels by count, most first, then by name."""
    return class_counts(df, label).orderBy(F.desc("n"), label)


def top_groups(df: DataFrame, group: str, k: int) -> DataFrame:
    """The ``k`` largest groups."""
    return class_counts(df, group).orderBy(F.desc("n"), group).limit(k)


def distribution(df: DataFrame, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per group: number of groups, rows, smallest, largest and mean size."""
    return (class_counts(df, group, by).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"),
                 F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.avg("n").alias("n_mean")))


def length_error(df: DataFrame, series: str, start: str, end: str, every: str) -> DataFrame:
    """Add ``error`` where a series has not one point per step of its window."""
    from flareframe.operators.ordered import interval_micros, micros
    want = F.floor((micros(end) - micros(start)) / interval_micros(every))
    return df.withColumn("error", F.when(F.size(series) != want, F.concat_ws(
        " ", F.lit("length"), F.size(series).cast("string"), F.lit("expected"), want.cast("string"))))


def across_runs(runs: DataFrame, run: str = "run", missing_as_zero: bool = False) -> DataFrame:
    """Statistics of split composition over runs.

    Input: run, category, split, label, n, frac.  Output per category, split,
    label and metric (count, frac): n, min, max, mean, median, sample std
    (0 for one run).  With ``missing_as_zero`` a run without a label counts as 0.
    """
    keys = ["category", "split", "label"]
    d = runs.select(run, *keys, F.col("n").cast("double").alias("n"), F.col("frac").cast("double"))
    if missing_as_zero:
        # every run meets every label of its category and split through that key
        have = d.select(*keys).distinct()
        per = d.select(run).distinct().groupBy().agg(F.collect_set(run)).scalar()
        full = have.withColumn(run, F.explode(per))
        d = full.join(d, [run, *keys], "left").na.fill(0.0, ["n", "frac"])
    long = d.select(*keys, F.explode(F.array(
        F.struct(F.lit("count").alias("metric"), F.col("n").alias("v")),
        F.struct(F.lit("frac").alias("metric"), F.col("frac").alias("v")))).alias("x"))
    return long.groupBy(*keys, F.col("x.metric").alias("metric")).agg(
        F.count("x.v").alias("n"), F.min("x.v").alias("min"), F.max("x.v").alias("max"),
        F.avg("x.v").alias("mean"), F.median("x.v").alias("median"),
        F.coalesce(F.stddev_samp("x.v"), F.lit(0.0)).alias("std"))


def spot_check(df: DataFrame, frames: str, cols: Sequence[str]) -> DataFrame:
    """Base names of the first and last frame next to the given columns."""
    from flareframe.functions.names import base_name
    return df.select(*cols, base_name(F.element_at(frames, 1)).alias("fname_start"),
                     base_name(F.element_at(frames, -1)).alias("fname_end"))


def anti_rows(df: DataFrame, kept: DataFrame, id: str) -> DataFrame:
    """Rows of ``df`` that are not in ``kept``."""
    return df.join(kept.select(id), id, "left_anti")


def output_order(df: DataFrame, ts: str, id: str, path: str) -> DataFrame:
    """Rows ordered by time, id and path, compared as text."""
    return df.orderBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (ts, id, path)])
