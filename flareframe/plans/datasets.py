"""Labelled item datasets: relabelling, image items, augmented clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flareframe.functions import labels as L
from flareframe.functions import names as N
from flareframe.operators import events as E
from flareframe.operators import grid as G
from flareframe.operators import reports as R
from flareframe.operators.ordered import interval_micros, micros
from flareframe.session import materialise


def relabel(df: DataFrame, scheme: str = "multi", threshold: str | None = None,
            col: str = "label", label_name: str = "label", id_name: str = "id") -> DataFrame:
    """Labels and ids of another scheme from four-class labels in ``col``; the
    four-class label and id stay as flare_type and flare_id."""
    maps = L.label_maps(scheme, threshold)
    base = L.base_label(F.col(col))
    new = L.lookup(maps["label"], base)
    return df.withColumns({"flare_type": base, "flare_id": L.lookup(L.LABEL_ID, base),
                           label_name: new, id_name: L.lookup(maps["label2id"], new)})


def image_items(labels: DataFrame, root: str, scheme: str = "multi",
                threshold: str | None = None, allow: DataFrame | None = None) -> DataFrame:
    """Image items from (ImgName, Label) rows: entity, time and stem from the name,
    optionally only entities in ``allow`` (column ``ar``)."""
    name = F.col("ImgName")
    d = labels.select(name, F.col("Label").alias("label")).withColumns({
        "ar": N.file_key(name), "timestamp": N.file_time(name), "sname": N.file_stem(name)})
    if allow is not None:
        d = d.join(allow.select("ar").distinct(), "ar", "left_semi")
    d = relabel(d, scheme, threshold)
    path = N.join_path(root, F.concat_ws("/", F.col("ar").cast("string"), "ImgName"))
    return d.where(F.col("label").isNotNull()).select(
        path.alias("filepath"), "sname", "label", "id", "ar", "timestamp", "flare_type", "flare_id")


def augment_clips(clips: DataFrame, flux: DataFrame, background: DataFrame, events: DataFrame,
                  id: str, every: str = "1 minute", min_coverage: float = 0.95,
                  horizon: str = "24 hours", gap: str = "0 hours", history: bool = True,
                  encoding: str = "binary", skip_ab: bool = False) -> DataFrame:
    """Clips with the flux ratio (and event history) of [t_start, t_end) on a regular
    grid, the event label after t_end, and ``error`` where that failed.

    ``flux`` (ts, flux) on the grid, ``background`` (date, background), ``events``
    as from ``normalise_events``: one instrument.  Errors, first that holds:
    window, coverage, background, length.
    """
    step = interval_micros(every)
    # labelled clips and the values at all their times are used several times and stored; sources are read once
    events = materialise(events.select("t_occ", "sev", "timestamp_start", "timestamp_end", "flare_type"))
    clips = materialise(E.label_ahead(clips, events, [], "t_end", horizon, gap, "__raw"))
    lo, hi = micros("t_start"), micros("t_end")
    want = F.floor((hi - lo + (step - 1)) / step)
    good = clips.where(F.col("t_end") > F.col("t_start"))
    times = good.select(F.col(id).alias("__id"), F.posexplode(F.sequence(lo, hi - 1, F.lit(step))).alias("pos", "__us"))
    times = times.withColumn("ts", G.from_micros(F.col("__us"))).drop("__us")
    ticks = materialise(times.select("ts").distinct())
    at = G.align(ticks, flux.select("ts", "flux"), [], "ts").withColumn("date", G.day_of("ts")) \
        .join(background.select("date", "background"), "date", "left").drop("date")
    if history:
        at = at.join(E.history_channel(ticks, events, [], "ts", encoding, skip_ab), "ts")
    pts = times.join(materialise(at), "ts").withColumn("__ok", G.is_finite(F.col("flux")).cast("double"))
    filled = G.fill_linear(pts, ["__id"], "pos", "flux")
    ratio = G.flux_ratio(filled, background, [], "ts", per="window")
    cols = ["ratio"] + (["hist"] if history else [])
    # a clip's grid is as long as the clip: arrays are bounded
    arr = (ratio.groupBy("__id").agg(
        F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("__a"),
        F.bool_and(F.col("ratio").isNotNull()).alias("bg_ok"), F.avg("__ok").alias("cov")))
    out = clips.withColumn("__id", F.col(id)).join(arr, "__id", "left")
    bad = R.first_reason([
        ("window", ~(F.col("t_end") > F.col("t_start"))),
        ("coverage", F.coalesce(F.col("cov"), F.lit(0.0)) < min_coverage),
        ("background", ~F.col("bg_ok")), ("length", F.size("__a") != want)])
    ts_type = L.fold_ab(F.col("__raw"))
    out = out.withColumn("xrs_error", F.nullif(bad, F.lit("ok")))
    ok = F.col("xrs_error").isNull()
    new = {"xrs_flux_ratio": F.when(ok, F.transform("__a", lambda x: x["ratio"])),
           "n_minutes": F.when(ok, F.size("__a")),
           "flare_ts_type": F.when(ok, ts_type),
           "flare_ts_id": F.when(ok, L.lookup(L.LABEL_ID, ts_type))}
    if history:
        new["flare_hist"] = F.when(ok, F.transform("__a", lambda x: x["hist"]))
    return out.withColumns(new).drop("__id", "__a", "bg_ok", "cov", "__raw")
