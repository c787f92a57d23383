"""Regular grids: resampling, alignment, gap filling, day windows, background ratio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flareframe.functions.arrays import field_of, is_finite, nan_to_null
from flareframe.operators.ordered import (interval_micros, micros, number_rows, running,
                                          time_segment)

DAY = 86_400_000_000


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def bin_start(ts: str | Column, every: str) -> Column:
    """Start of the ``every`` bin holding ``ts`` (bins counted from the epoch)."""
    step = interval_micros(every)
    return from_micros(F.floor(micros(ts) / F.lit(step)) * F.lit(step))


def day_of(ts: str | Column) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts).cast("date")


def make_grid(ranges: DataFrame, keys: Sequence[str], first: str, last: str, ts: str,
              every: str) -> DataFrame:
    """Every ``every`` step from ``first`` to ``last`` per row of ``ranges``.

    Built in two levels, days then steps inside a day, with the days spread
    over the cluster in between, so one long range neither forms one giant
    array nor one long task.
    """
    step = interval_micros(every)
    big = max(step, (DAY // step) * step)
    lo, hi = micros(first), micros(last)
    chunks = ranges.select(*keys, hi.alias("__hi"), F.explode(
        F.sequence(lo, hi, F.lit(big))).alias("__lo"))
    chunks = chunks.repartition(*[F.col(k) for k in keys], F.col("__lo"))
    inner = F.sequence(F.col("__lo"), F.least(F.col("__hi"), F.col("__lo") + (big - step)),
                       F.lit(step))
    return chunks.select(*keys, F.explode(inner).alias("__us")) \
        .select(*keys, from_micros(F.col("__us")).alias(ts))


def resample_mean(df: DataFrame, keys: Sequence[str], ts: str, value: str,
                  every: str) -> DataFrame:
    """Mean per bin; empty bins between the first and last one appear with null."""
    binned = (df.select(*keys, bin_start(ts, every).alias(ts), nan_to_null(F.col(value)).alias(value))
              .groupBy(*keys, ts).agg(F.avg(value).alias(value)))
    ranges = df.groupBy(*keys).agg(bin_start(F.min(ts), every).alias("__first"),
                                   bin_start(F.max(ts), every).alias("__last"))
    grid = make_grid(ranges, keys, "__first", "__last", ts, every)
    return grid.join(binned, [*keys, ts], "left")


def align(grid: DataFrame, samples: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Samples placed on the rows of a grid; grid rows without a sample get null."""
    return grid.join(samples, [*keys, ts], "left")


def first_per_day(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Per day, the earliest non-null value and the earliest time (each on its own)."""
    v = nan_to_null(F.col(value))
    return (df.where(F.col(ts).isNotNull())
            .groupBy(*keys, day_of(ts).alias("date"))
            .agg(F.min(ts).alias(ts),
                 F.min_by(v, F.when(v.isNotNull(), F.col(ts))).alias(value)))


def fill_linear(df: DataFrame, keys: Sequence[str], order: str, value: str,
                segment: Column | None = None) -> DataFrame:
    """Linear fill of missing values by row position, nearest value at both ends.

    ``order`` is the position inside the key.  Without ``segment`` a key is one
    window or clip, whose length is fixed by its width.  For whole series give
    a ``segment`` monotone in ``order``; the fill then crosses segments.
    """
    v = nan_to_null(F.col(value).cast("double"))
    pos = F.col(order)
    known = F.when(v.isNotNull(), F.struct(pos.alias("p"), v.alias("v")))
    if segment is None:
        part, upto = Window.partitionBy(*keys), (Window.unboundedPreceding, 0)
        out = df.withColumns({
            "__a": F.last(known, True).over(part.orderBy(order).rowsBetween(*upto)),
            # the next value is the last one of the reversed order: one growing frame
            "__b": F.last(known, True).over(part.orderBy(F.desc(order)).rowsBetween(*upto))})
    else:
        out = running(df, keys, [order], segment, __a=("last", known), __b=("next", known))
    a, b = F.col("__a"), F.col("__b")
    span = F.nullif((b["p"] - a["p"]).cast("double"), F.lit(0.0))
    filled = F.coalesce(v, a["v"] + (b["v"] - a["v"]) * ((pos - a["p"]) / span), a["v"], b["v"])
    return out.withColumn(value, filled).drop("__a", "__b")


def day_windows(background: DataFrame, keys: Sequence[str], ts: str, width: str,
                stride: str | None = None, align_to: str = "midnight") -> DataFrame:
    """Window (start, end) rows anchored at each background row.

    Starts run from the day's midnight (``align_to='midnight'``) or from the
    background time itself, every ``stride`` (default ``width``), and stop
    before the next day.
    """
    stride_us = interval_micros(stride or width)
    if stride_us <= 0:
        raise ValueError("stride must be positive")
    day0 = micros(day_of(ts).cast("timestamp_ntz"))
    anchor = day0 if align_to == "midnight" else micros(ts)
    starts = F.explode(F.sequence(anchor, day0 + F.lit(DAY - 1), F.lit(stride_us)))
    return (background.withColumn("__s", starts)
            .withColumn("start", from_micros(F.col("__s")))
            .withColumn("end", from_micros(F.col("__s") + F.lit(interval_micros(width))))
            .drop("__s"))


def window_points(points: DataFrame, windows: DataFrame, keys: Sequence[str], ts: str,
                  every: str, width: str) -> DataFrame:
    """Points of each window [start, end): each window expands to its own grid times
    and picks the points up by an equi-join, so no range condition is needed.

    ``points`` must lie on the ``every`` grid.  Adds ``pos`` (0-based) and keeps
    rows of the data range only (no row where the point table has none).
    """
    step, n = interval_micros(every), interval_micros(width) // interval_micros(every)
    # the first grid time at or after the window start
    first = F.ceil(micros("start") / F.lit(step)).cast("long") * F.lit(step)
    grid = windows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) \
        .withColumn(ts, from_micros(first + F.col("__i") * F.lit(step))) \
        .where(F.col(ts) < F.col("end")).withColumnRenamed("__i", "pos")
    return grid.join(points, [*keys, ts], "inner")


def valid_background(col: Column) -> Column:
    return is_finite(col) & (col > 0)


def flux_ratio(points: DataFrame, background: DataFrame, keys: Sequence[str], ts: str,
               value: str = "flux", per: str = "day") -> DataFrame:
    """value / background as float.

    ``per='day'`` joins each point to its own day's background; with
    ``per='window'`` the points already carry their window's ``background``.
    """
    if per == "day":
        points = points.withColumn("date", day_of(ts)).join(
            background.select(*keys, "date", "background"), [*keys, "date"], "left")
    return points.withColumn("ratio", F.when(
        valid_background(F.col("background")),
        (F.col(value) / F.col("background")).cast("float")))


def skip_years(df: DataFrame, ts: str, years: Sequence[int]) -> DataFrame:
    return df.where(~F.year(ts).isin(*years)) if years else df


def in_month_ranges(ts: str, ranges: Sequence[str]) -> Column:
    """True inside any 'YYYY-MM:YYYY-MM' range, its last day included whole."""
    hit = F.lit(False)
    for r in ranges:
        a, b = r.split(":")
        end = F.add_months(F.lit(f"{b}-01").cast("date"), 1).cast("timestamp_ntz")
        hit = hit | ((F.col(ts) >= F.lit(f"{a}-01").cast("date").cast("timestamp_ntz"))
                     & (F.col(ts) < end))
    return hit


def skip_ranges(df: DataFrame, ts: str, ranges: Sequence[str]) -> DataFrame:
    return df.where(~in_month_ranges(ts, ranges)) if ranges else df


def coverage(valid: Column, present: Column, expected: int | None = None,
             mode: str = "present") -> Column:
    """Share of valid points: of the rows present, or of the full grid."""
    return F.try_divide(valid.cast("double"),
                        present.cast("double") if mode == "present" else F.lit(float(expected)))


def columns_to_arrays(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                      points: int) -> DataFrame:
    """One record of column arrays per series, in time order.

    NaN becomes null and times become text.  Every ``points``
    rows of a series make a record (column ``part``, 0-based; the last may be
    shorter), so the caller says how long an array may be.
    """
    types = dict(df.dtypes)
    p = number_rows(df.select(*keys, ts, *cols), keys, [ts, *cols], time_segment(ts), "__rn")
    p = p.withColumn("part", F.floor((F.col("__rn") - 1) / points))
    vals = [F.col("__rn"), F.col(ts)] + [
        nan_to_null(F.col(c)).alias(c) if types[c] in ("double", "float") else F.col(c) for c in cols]
    arr = (p.groupBy(*keys, "part")
           .agg(F.array_sort(F.collect_list(F.struct(*vals))).alias("__a")))
    stamp = F.transform("__a", lambda x: F.date_format(x[ts], "yyyy-MM-dd'T'HH:mm:ss"))
    return arr.select(*keys, "part", F.size("__a").cast("long").alias("n_points"), stamp.alias(ts),
                      *[field_of("__a", c).alias(c) for c in cols])
