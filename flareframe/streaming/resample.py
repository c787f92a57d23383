"""Resampling of a live sample stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flareframe.functions.arrays import nan_to_null


def resample_stream(df: DataFrame, keys: Sequence[str], ts: str, value: str, every: str,
                    late: str = "1 hour") -> DataFrame:
    """Mean per bin of a streaming DataFrame; samples later than ``late`` are dropped.

    Same bins as ``resample_mean``.  State is one row per key and open bin.
    Empty bins cannot be told from late ones on a stream, so they are left to
    the reader's grid.
    """
    d = df.select(*keys, F.col(ts).cast("timestamp").alias(ts),
                  nan_to_null(F.col(value)).alias(value)).withWatermark(ts, late)
    g = d.groupBy(*keys, F.window(ts, every).alias("w")).agg(F.avg(value).alias(value))
    return g.select(*keys, F.col("w.start").cast("timestamp_ntz").alias(ts), value)


def run_bins(bins: DataFrame, folder: str) -> None:
    """Run the stream over what is there, in update mode, so bins the watermark has passed leave the state.

    A batch overwrites the folder of its own number; running one again after a failure changes nothing.
    """
    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/bins/batch={number}")

    (bins.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
     .trigger(availableNow=True).foreachBatch(sink).start().awaitTermination())


def latest_bins(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The last value of every bin that ``run_bins`` wrote."""
    d = spark.read.parquet(f"{folder}/bins")
    rest = [c for c in d.columns if c not in (*keys, "batch")]
    return (d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
            .select(*keys, *[F.col("r")[c].alias(c) for c in rest]))
