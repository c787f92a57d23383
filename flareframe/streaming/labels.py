"""Event labels of a live stream of windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flareframe.functions.labels import class_of_severity
from flareframe.operators.ordered import interval, interval_micros, micros


def label_ahead_stream(windows: DataFrame, events: DataFrame, keys: Sequence[str], id: str, t_end: str, horizon: str,
                       gap: str = "0 hours", late: str = "1 hour") -> DataFrame:
    """(id, t_end, sev) rows of two streams: a class in (t_end + gap, t_end + gap + horizon], or none (null).

    ``events``: ``keys``, ``t_occ`` and ``sev``.  Time is cut into bins as long as the horizon, so a range covers the end
    of one bin and the begin of the next.  Whether a class is in it follows from the first and the last time of that class
    in either bin, so events are reduced to one row per key, bin and class before windows meet them: a window gives a few
    rows however dense the events are.  Rows more than ``late`` behind their stream are dropped.  A window comes out once
    the watermarks have passed the bins, without a class in a bin once they have passed two horizons after it, and no
    state is kept after that: state is the windows of about two horizons and a row per key, open bin and class.  The highest
    class of a window is the maximum over its rows (:func:`latest_labels`), the same as ``label_ahead`` gives in batch.
    """
    step = interval_micros(horizon)

    def bin_of(c: Column) -> Column:
        return F.floor(micros(c) / F.lit(step))
    lo = F.col("w_end") + interval(gap)
    hi = F.col("w_end") + interval(f"{interval_micros(gap) + step} microseconds")
    w = windows.select(F.col(id).alias("id"), F.col(t_end).cast("timestamp").alias("w_end"), *[F.col(k).alias(f"w_{k}") for k in keys]) \
        .withWatermark("w_end", late)
    w = w.withColumn("w_bin", F.explode(F.array_distinct(F.array(bin_of(lo), bin_of(hi)))))
    e = events.select(F.col("t_occ").cast("timestamp").alias("t_occ"), "sev", *[F.col(k).alias(f"e_{k}") for k in keys]) \
        .withWatermark("t_occ", late)
    e = e.groupBy(*[f"e_{k}" for k in keys], F.window("t_occ", f"{step} microseconds").alias("bin"), "sev").agg(
        F.min(micros("t_occ")).alias("first"), F.max(micros("t_occ")).alias("last"))
    # the bin's last microsecond is its event time; it lies within two horizons after the begin of every range that meets
    # it.  First and last are numbers and each sum has one interval, because Spark derives from times and sums in the
    # condition when rows leave the state, and counts equal intervals of a sum once
    reach = F.col("w_end") + interval(f"{interval_micros(gap) + 2 * step} microseconds")
    e = e.withColumns({"e_bin": bin_of(F.col("bin.start")), "e_end": F.window_time("bin")})
    meets = ((F.col("w_bin") == F.col("e_bin")) & (F.col("last") > micros(lo)) & (F.col("first") <= micros(hi))
             & (F.col("e_end") >= lo) & (F.col("e_end") < reach))
    for k in keys:
        meets = meets & (F.col(f"w_{k}") == F.col(f"e_{k}"))
    return w.join(e, meets, "leftOuter").select("id", F.col("w_end").cast("timestamp_ntz").alias("t_end"), "sev")


def run_labels(labels: DataFrame, folder: str) -> None:
    """Run the stream over what is there.  A batch overwrites the folder of its own number, so one that runs again
    after a failure changes nothing; the next call goes on from the checkpoint."""
    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/labels/batch={number}")

    (labels.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state")
     .trigger(availableNow=True).foreachBatch(sink).start().awaitTermination())


def latest_labels(spark: SparkSession, folder: str, name: str = "flare_class") -> DataFrame:
    """(id, t_end, class) of every window that has come out so far."""
    return (spark.read.parquet(f"{folder}/labels").groupBy("id", "t_end").agg(F.coalesce(F.max("sev"), F.lit(0)).alias("sev"))
            .select("id", "t_end", class_of_severity(F.col("sev")).alias(name)))
