"""Questions about events near windows and grid points.

An event table answers 'worst class in a time range' without any range join.
Classes are few and ordered, so for each class the time of the next event of
that class *or worse* is carried backwards over the merged time line of events
and windows; the range then holds such an event exactly when that time is not
past its end.  Work is one sort of events + windows; no event-window pairs are
formed, and time segments keep a single hot key parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flareframe.functions import labels as L
from flareframe.operators.ordered import interval, interval_micros, micros, running


def normalise_events(df: DataFrame) -> DataFrame:
    """Raw event table to t_occ, class, sev, start, end, flare_type.

    Column names match in any case and with the usual aliases; times that do
    not parse are null; the peak time wins over the start; rows without a time
    or a class A..X are dropped.
    """
    # Accepted column names.
    alias = {"timestamp": "timestamp", "timestamp_start": "timestamp_start",
             "start_time": "timestamp_start", "timestamp_end": "timestamp_end",
             "flare_type": "flare_type", "class": "flare_type"}
    cols: dict[str, list[Column]] = {}
    for c in df.columns:
        if c.lower() in alias:
            cols.setdefault(alias[c.lower()], []).append(F.col(f"`{c}`"))

    def time(name: str) -> Column:
        parts = [F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz")
                 for c in cols.get(name, [])]
        return F.coalesce(*parts) if parts else F.lit(None).cast("timestamp_ntz")

    text = F.coalesce(*cols["flare_type"]) if "flare_type" in cols else F.lit(None).cast("string")
    cls = L.class_letter(text)
    return (df.select(F.coalesce(time("timestamp"), time("timestamp_start")).alias("t_occ"),
                      cls.alias("class"), L.severity(cls).alias("sev"),
                      time("timestamp_start").alias("timestamp_start"),
                      time("timestamp_end").alias("timestamp_end"), text.alias("flare_type"))
            .where(F.col("t_occ").isNotNull() & F.col("class").isin(*L.CLASSES)))


def worst_between(windows: DataFrame, events: DataFrame, keys: Sequence[str], lo: Column,
                  hi: Column, closed_left: bool, closed_right: bool = True,
                  name: str = "sev", segment: str = "1 hour") -> DataFrame:
    """Add to ``windows`` the highest ``sev`` of events between ``lo`` and ``hi`` (0 if none).

    ``events`` has ``keys``, ``t_occ`` and ``sev`` (1..5).  A window with a null bound
    stays, with 0.
    """
    top = max(L.SEVERITY.values())
    wcols = windows.columns
    marks = windows.withColumns({"__t": micros(lo), "__hi": micros(hi),
                                 "__k": F.lit(0 if closed_left else 1), "__window": F.lit(True)})
    evs = events.select(*keys, micros("t_occ").alias("__t"), F.col("sev").cast("int").alias("__sev"),
                        F.lit(1 if closed_left else 0).alias("__k")) \
        .where(F.col("__sev") > 0)
    # one row per key, time and class is enough; this also thins repeated events
    evs = evs.groupBy(*keys, "__t", "__k").agg(F.max("__sev").alias("__sev"))
    line = marks.unionByName(evs, allowMissingColumns=True) \
        .withColumn("__o", F.col("__t") * 2 + F.col("__k"))
    specs = {f"__n{s}": ("next", F.when(F.col("__sev") >= s, F.col("__t")))
             for s in range(1, top + 1)}
    seg = F.floor(F.col("__t") / F.lit(interval_micros(segment)))
    out = running(line, keys, ["__o"], seg, **specs)
    sev = F.lit(0)
    for s in range(1, top + 1):     # the worst class with an event in time wins
        n = F.col(f"__n{s}")
        ok = ((n <= F.col("__hi")) if closed_right else (n < F.col("__hi"))) & F.col("__t").isNotNull()
        sev = F.when(ok, F.lit(s)).otherwise(sev)
    return out.where(F.col("__window")).select(*wcols, sev.alias(name))


def label_ahead(windows: DataFrame, events: DataFrame, keys: Sequence[str], t_end: str,
                horizon: str, gap: str = "0 hours", name: str = "flare_class") -> DataFrame:
    """Highest event class in (t_end + gap, t_end + gap + horizon]."""
    lo = F.col(t_end) + interval(gap)
    out = worst_between(windows, events, keys, lo, lo + interval(horizon), closed_left=False,
                        name="__sev_ahead")
    return out.withColumn(name, L.class_of_severity(F.col("__sev_ahead"))).drop("__sev_ahead")


def events_within(windows: DataFrame, events: DataFrame, keys: Sequence[str], start: str,
                  end: str, name: str = "sev_within") -> DataFrame:
    """Highest severity inside the closed range [start, end], 0 if none."""
    return worst_between(windows, events, keys, F.col(start), F.col(end), closed_left=True,
                         name=name)


def no_event_at_least(windows: DataFrame, events: DataFrame, keys: Sequence[str], start: str,
                      end: str, cls: str) -> DataFrame:
    """Windows without an event of class ``cls`` or worse in [start, end]."""
    out = events_within(windows, events, keys, start, end, "__within")
    return out.where(F.col("__within") < L.SEVERITY[cls]).drop("__within")


def history_channel(grid: DataFrame, events: DataFrame, keys: Sequence[str], ts: str,
                    encoding: str = "binary", skip_ab: bool = False, name: str = "hist",
                    segment: str = "1 hour") -> DataFrame:
    """Value of the strongest event going on at each grid time, 0 outside events.

    A sweep: every event adds one to its level's counter at its start and takes
    it away just after its end, so cost does not depend on event length.
    ``events`` has ``timestamp_start``, ``timestamp_end`` (both needed) and
    ``flare_type``.
    """
    # Channel codes per class.
    codes = {"C": 1, "M": 2, "X": 3} if skip_ab else {"A": 1, "B": 2, "C": 3, "M": 4, "X": 5}
    letter = F.upper(F.substring(F.trim(F.col("flare_type")), 1, 1))
    val = L.lookup(codes, letter, 1) if encoding == "ordinal" else F.lit(1)
    evs = events.where(F.col("timestamp_start").isNotNull() & F.col("timestamp_end").isNotNull()
                       & (F.col("timestamp_start") <= F.col("timestamp_end")))
    if skip_ab:
        evs = evs.where(~F.coalesce(letter.isin("A", "B"), F.lit(False)))
    evs = evs.select(*keys, val.alias("__v"), micros("timestamp_start").alias("__s"),
                     micros("timestamp_end").alias("__e"))
    # kinds: 0 start, 1 grid point, 2 end -- so both bounds are inside
    edges = evs.select(*keys, "__v", F.explode(F.array(
        F.struct(F.col("__s").alias("t"), F.lit(0).alias("k"), F.lit(1).alias("d")),
        F.struct(F.col("__e").alias("t"), F.lit(2).alias("k"), F.lit(-1).alias("d")))).alias("x")) \
        .groupBy(*keys, "__v", F.col("x.t").alias("__t"), F.col("x.k").alias("__k")) \
        .agg(F.sum("x.d").alias("__d"))
    gcols = grid.columns
    marks = grid.withColumns({"__t": micros(ts), "__k": F.lit(1)})
    line = marks.unionByName(edges, allowMissingColumns=True) \
        .withColumn("__o", F.col("__t") * 4 + F.col("__k"))
    levels = sorted(set(codes.values())) if encoding == "ordinal" else [1]
    specs = {f"__on{v}": ("sum", F.when(F.col("__v") == v, F.col("__d")).otherwise(0))
             for v in levels}
    out = running(line, keys, ["__o"], F.floor(F.col("__t") / F.lit(interval_micros(segment))),
                  **specs)
    hist = F.lit(0.0)
    for v in levels:
        hist = F.when(F.col(f"__on{v}") > 0, F.lit(float(v))).otherwise(hist)
    return out.where(F.col("__k") == 1).select(*gcols, hist.cast("float").alias(name))

