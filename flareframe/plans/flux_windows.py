"""Labelled flux windows: resample, cut into day windows, reject, normalise, label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flareframe.functions import labels as L
from flareframe.functions.arrays import nan_to_null
from flareframe.operators import events as E
from flareframe.operators import grid as G
from flareframe.operators import reports as R
from flareframe.operators.ordered import interval, interval_micros, micros
from flareframe.session import materialise

KEY = ["satellite"]


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def window_metadata(win: DataFrame, every: str, width: str, gap: str) -> DataFrame:
    """Epoch seconds and formatted times of windows and of their forecast range."""
    lo = F.col("end") + interval(gap)
    hi = lo + interval(width)

    def sec(c):
        return micros(c).cast("double") / 1e6

    return win.withColumns({
        "t_start": sec(F.col("start")), "t_end": sec(F.col("end")), "date_start": _stamp("start"),
        "date_end": _stamp("end"), "dt": F.lit(interval_micros(every) / 1e6),
        "date_forecast_start": _stamp(lo), "date_forecast_end": _stamp(hi),
        "t_forecast_start": sec(lo), "t_forecast_end": sec(hi)})


def label_windows(flux: DataFrame, background: DataFrame, events: DataFrame,
                  every: str = "1 minute", width: str = "24 hours", stride: str | None = None,
                  align_to: str = "midnight", min_coverage: float = 0.95,
                  coverage: str = "present", gap: str = "0 hours",
                  skip_years: Sequence[int] = (), skip_ranges: Sequence[str] = (),
                  skip_at_least: str = "NONE", history: str | None = None,
                  skip_ab: bool = False) -> DataFrame:
    """Every window of every satellite with its points, label and reject ``reason``.

    flux (satellite, ts, flux), background (satellite, ts, background), events as
    from ``normalise_events``.  Reasons, first that holds: year, date_range,
    coverage, background, event; ``ok`` otherwise.  Kept windows are the rows
    with reason ok.
    """
    n = interval_micros(width) // interval_micros(every)
    # the resampled series, the events and the windows are stored: each is much smaller than what it comes from and
    # is used several times, while every source is read once (the flux twice: its bins and their range)
    grid = materialise(G.resample_mean(flux, KEY, "ts", "flux", every))
    events = materialise(events.select("t_occ", "sev", "timestamp_start", "timestamp_end", "flare_type"))
    bg = G.first_per_day(background, KEY, "ts", "background")
    win = materialise(G.day_windows(bg.drop("date"), KEY, "ts", width, stride, align_to).drop("ts"))
    win = E.label_ahead(win, events, [], "end", width, gap, "flare_class")
    if skip_at_least != "NONE":
        win = E.events_within(materialise(win), events, [], "start", "end", "sev_in")
    else:
        win = win.withColumn("sev_in", F.lit(0))
    win = materialise(win)
    pts = G.window_points(grid, win.select(*KEY, "start", "end", "background"), KEY, "ts", every, width)
    w = ["satellite", "start"]
    fill = pts.withColumn("__ok", nan_to_null(F.col("flux")).isNotNull())
    fill = G.flux_ratio(G.fill_linear(fill, w, "pos", "flux"), win, KEY, "ts", per="window")
    cols = ["ratio"]
    if history:
        ticks = grid.select("ts").distinct()
        fill = fill.join(materialise(E.history_channel(ticks, events, [], "ts", history, skip_ab)), "ts")
        cols.append("hist")
    arr = fill.groupBy(*w).agg(F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("__a"),
                               F.count_if("__ok").alias("n_valid"), F.count(F.lit(1)).alias("n_points"))
    out = win.join(arr, w, "left")
    share = G.coverage(F.coalesce("n_valid", F.lit(0)), F.coalesce("n_points", F.lit(0)), n, coverage)
    reason = R.first_reason([
        ("year", F.year("start").isin(*skip_years) if skip_years else F.lit(False)),
        ("date_range", G.in_month_ranges("start", skip_ranges)),
        ("coverage", F.coalesce(share, F.lit(0.0)) < min_coverage),
        ("background", ~G.valid_background(F.coalesce("background", F.lit(0.0)))),
        ("event", F.col("sev_in") >= L.SEVERITY[skip_at_least]
         if skip_at_least != "NONE" else F.lit(False))])
    label = L.fold_ab(F.col("flare_class"))
    out = out.withColumns({"reason": reason, "label": label, "id": L.lookup(L.LABEL_ID, label),
                           "flare_type": label, "flare_id": L.lookup(L.LABEL_ID, label),
                           "xrs_flux_ratio": F.transform("__a", lambda x: x["ratio"])})
    if history:
        out = out.withColumn("flare_hist", F.transform("__a", lambda x: x["hist"]))
    return window_metadata(out, every, width, gap).drop("__a", "sev_in", "n_valid", "flare_class")


def build_windows(*args, **kwargs) -> DataFrame:
    """Only the windows that pass every rule."""
    return label_windows(*args, **kwargs).where("reason = 'ok'").drop("reason")


def flatten_windows(df: DataFrame, n: int, include_history: bool = False) -> DataFrame:
    """Wide table t0, r1..rN[, h1..hN], label; windows of another length or with
    missing values are left out."""
    def whole(c: str):
        return (F.size(c) == n) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x))

    ok = whole("xrs_flux_ratio")
    cols = [F.get("xrs_flux_ratio", F.lit(i)).alias(f"r{i + 1}") for i in range(n)]
    if include_history:
        ok = ok & whole("flare_hist")
        cols += [F.get("flare_hist", F.lit(i)).alias(f"h{i + 1}") for i in range(n)]
    return df.where(ok).select(F.col("date_start").alias("t0"), *cols, "label")


def window_index(df: DataFrame) -> DataFrame:
    """One index row per kept window."""
    has = F.col("flare_hist").isNotNull() if "flare_hist" in df.columns else F.lit(False)
    return df.select("satellite", F.col("date_start").alias("start_time"),
                     F.col("date_end").alias("end_time"), "label",
                     F.col("n_points").cast("long").alias("n_points"), has.alias("has_hist"))
