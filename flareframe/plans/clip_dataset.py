"""From labelled frames to a balanced, leak-free clip dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flareframe.operators import sampling as M
from flareframe.operators import sequences as Q
from flareframe.operators import splits as S
from flareframe.plans.datasets import relabel


def build(frames: DataFrame, n: int, frame_step: str, cadence: str, fractions=(0.7, 0.15, 0.15),
          target_total: int | None = None, targets: dict[str, int] | None = None, seed: int = 42,
          scheme: str = "multi", threshold: str | None = None) -> DataFrame:
    """Clips from frames (ar, ts, file, label), downsampled per label and entity, relabelled
    and split so that no entity straddles splits.

    Adds ``clip_id`` (entity and start time), ``split``, and the label columns of the scheme.
    """
    c = Q.clips(frames, ["ar"], "ts", "file", "label", n, frame_step, cadence)
    c = c.withColumn("clip_id", F.concat_ws("_", F.col("ar").cast("string"),
                                            F.date_format("t_start", "yyyyMMddHHmmss")))
    if target_total is not None or targets:
        c = M.downsample(c, "clip_id", "ar", "label", target_total, targets, seed)
        c = c.where("keep").drop("keep")
    c = relabel(c, scheme, threshold)
    goal = {s: round(f * 1_000_000) for s, f in zip(S.SPLITS, fractions)}
    return S.group_split(c, "ar", goal, seed, item="clip_id")
