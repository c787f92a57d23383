"""From rows of magnetic features to labelled, normalised series per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flareframe.functions.labels import label_struct
from flareframe.operators import sequences as Q
from flareframe.operators import series as S
from flareframe.operators.ordered import interval_micros


def build(rows: DataFrame, n: int, every: str, horizon: str, step: int = 1, stride: int | None = None,
          n_features: int = 29) -> DataFrame:
    """Labelled records of ``n`` points, ``step`` rows apart, from gap-free stretches of feature rows.

    ``rows``: ar, ts, features, reg_label (as ``readers.read_feature_rows`` gives; rows with ``error`` set are left
    out).  The label is that of the last point.  Gives ar, npoints, dt (minutes between points), forecast_horizon,
    date_start, date_end, flare_type, flare_id, label, id and one array column per feature, feat1 ...
    """
    if "error" in rows.columns:
        rows = rows.where("error IS NULL")
    flat = rows.select("ar", "ts", "features", "reg_label")
    s = Q.fixed_series(flat, ["ar"], "ts", ["features"], n, step, stride, every, label="reg_label")
    feats = [F.transform("features", lambda p: F.get(p, F.lit(i))).alias(f"feat{i + 1}") for i in range(n_features)]
    lab = label_struct(F.col("reg_label"))
    minutes = interval_micros(every) * step // 60_000_000
    return s.select("ar", "npoints", F.lit(minutes).cast("long").alias("dt"), F.lit(horizon).alias("forecast_horizon"),
                    F.date_format("t_start", "yyyy-MM-dd HH:mm:ss").alias("date_start"),
                    F.date_format("t_end", "yyyy-MM-dd HH:mm:ss").alias("date_end"),
                    lab["flare_type"].alias("flare_type"), lab["flare_id"].alias("flare_id"),
                    lab["label"].alias("label"), lab["id"].alias("id"), *feats)


def normalise(series: DataFrame, kind: str, stats: DataFrame | None = None, n_features: int = 29) -> DataFrame:
    """Every feature scaled by ``stats``, or by statistics of the series themselves where none are given."""
    cols = [f"feat{i + 1}" for i in range(n_features)]
    return S.apply_scaler(series, cols, S.fit_scaler(series, cols, kind) if stats is None else stats, kind)
