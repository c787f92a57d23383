"""Per-entity sequences in time order: cadence checks, islands, series, clips, horizons.

All of them number the rows of an entity exactly (``number_rows``) and then
work in bounded row blocks (``with_context``), so the longest entity is split
over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flareframe.functions import labels as L
from flareframe.functions.arrays import field_of, let, regular
from flareframe.functions.names import file_time_any
from flareframe.operators.ordered import (BLOCK_ROWS, block_window, home, interval,
                                          interval_micros, micros, number_rows, running,
                                          time_segment, with_context)


def positions(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (),
              name: str = "rn", segment: str = "1 hour") -> DataFrame:
    """1-based position of each row of an entity in time order."""
    return number_rows(df, keys, [ts, *tie], time_segment(ts, segment), name)


def cadence_report(df: DataFrame, keys: Sequence[str], ts: str, every: str,
                   tie: Sequence[str] = (), block: int = BLOCK_ROWS) -> DataFrame:
    """Neighbour pairs not exactly ``every`` apart: previous time and the gap in minutes."""
    n = with_context(positions(df, keys, ts, tie), before=1, block=block)
    prev = F.lag(ts).over(block_window(keys))
    out = home(n.withColumn("prev_ts", prev))
    gap = (micros(ts) - micros("prev_ts")) / 60e6
    return (out.withColumn("gap_min", gap)
            .where(F.col("gap_min") != interval_micros(every) / 60e6).drop("rn"))


def unsorted(df: DataFrame, keys: Sequence[str], ts: str, order: str,
             block: int = BLOCK_ROWS) -> DataFrame:
    """Rows whose time is not strictly after the row before it in ``order``."""
    from flareframe.operators.ordered import with_quantile_segment
    n = with_quantile_segment(df, order)
    n = number_rows(n, keys, [order], F.col("__qseg")).drop("__qseg")
    n = with_context(n, before=1, block=block)
    out = home(n.withColumn("prev_ts", F.lag(ts).over(block_window(keys))))
    return out.where(F.col(ts) <= F.col("prev_ts")).drop("rn")


def require_sorted(df: DataFrame, keys: Sequence[str], ts: str, order: str) -> DataFrame:
    """The input itself, after failing clearly if any entity is out of time order."""
    bad = unsorted(df, keys, ts, order).select(*keys, ts).take(1)
    if bad:
        raise ValueError(f"rows not strictly increasing in time, first: {bad[0].asDict()}")
    return df


def islands(df: DataFrame, keys: Sequence[str], ts: str, every: str, tie: Sequence[str] = (),
            block: int = BLOCK_ROWS) -> DataFrame:
    """Add ``island`` (0, 1, ... per entity) and ``pos`` (0-based inside the island);
    an island breaks at any gap other than ``every``."""
    n = with_context(positions(df, keys, ts, tie), before=1, block=block)
    same = micros(ts) - F.lag(micros(ts)).over(block_window(keys)) == interval_micros(every)
    n = home(n.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)))
    seg = F.floor((F.col("rn") - 1) / block)
    start = F.when(F.col("__new") == 1, F.col("rn"))
    out = running(n, keys, ["rn"], seg, island=("sum", F.col("__new")), __start=("last", start))
    return (out.withColumn("island", F.col("island") - 1)
            .withColumn("pos", F.col("rn") - F.col("__start")).drop("__new", "__start", "rn"))


def fixed_series(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], n: int,
                 step: int = 1, stride: int | None = None, every: str = "12 minutes",
                 label: str | None = None, block: int = 8192) -> DataFrame:
    """Series of ``n`` points, ``step`` rows apart, starting every ``stride`` rows of
    each gap-free island (default: non-overlapping); label of the last point.

    Each row joins the at most ceil(n*step/stride) series it belongs to; a
    series is kept only when complete.
    """
    stride = stride or n * step
    stride = max(stride, 1)
    isl = islands(df, keys, ts, every, block=block)
    pos = F.col("pos")
    first = (F.ceil(F.greatest(pos - (n - 1) * step, F.lit(0)) / stride) * stride).cast("long")
    own = F.filter(F.sequence(first, pos.cast("long"), F.lit(stride).cast("long")), lambda s: (pos - s) % step == 0)
    starts = F.when(first <= pos, F.transform(own, lambda s: F.struct(
        s.alias("s"), ((pos - s) / step).cast("long").alias("k"))))
    cols = [ts, *values] + ([label] if label and label not in values else [])
    pts = isl.select(*keys, "island", *cols, F.explode(starts).alias("__x"))
    pts = pts.select(*keys, "island", F.col("__x.s").alias("start_pos"), F.struct(
        F.col("__x.k").alias("__k"), *cols).alias("__p"))
    # a series has at most n rows: the group is bounded by construction
    out = (pts.groupBy(*keys, "island", "start_pos")
           .agg(F.array_sort(F.collect_list("__p")).alias("__a"))
           .where(F.size("__a") == n))
    extra = [F.element_at("__a", -1)[label].alias(label)] if label else []
    return out.select(*keys, "island", "start_pos", F.lit(n).cast("long").alias("npoints"),
                      F.get("__a", F.lit(0))[ts].alias("t_start"),
                      F.element_at("__a", -1)[ts].alias("t_end"),
                      *[field_of("__a", v).alias(v) for v in values
                        if v != label], *extra)


def clips(df: DataFrame, keys: Sequence[str], ts: str, file: str, label: str, n: int,
          frame_step: str, cadence: str, tie: Sequence[str] = (),
          block: int = BLOCK_ROWS) -> DataFrame:
    """Clips of ``n`` frames from every start row, ``frame_step / cadence`` rows apart;
    kept when complete and all gaps equal ``frame_step``; label of the last frame."""
    step = interval_micros(frame_step) // interval_micros(cadence)
    reach = (n - 1) * step
    num = with_context(positions(df, keys, ts, tie), after=reach, block=block)
    w = block_window(keys)

    def ahead(c: str) -> Column:
        return F.array(*[F.lead(c, k * step).over(w) for k in range(n)])

    out = home(num.withColumns({"filepaths": ahead(file), "__t": ahead(ts),
                                "__label": F.lead(label, reach).over(w)}))
    out = out.where(F.forall("__t", lambda x: x.isNotNull()) & regular(F.col("__t"), frame_step))
    return out.select(*keys, "filepaths", F.col("__label").alias(label),
                      F.get("__t", F.lit(0)).alias("t_start"),
                      F.element_at("__t", -1).alias("t_end"), F.col("__t").alias("timestamps"))


def labels_at_steps(df: DataFrame, keys: Sequence[str], ts: str, label: str,
                    steps: Sequence[int], tie: Sequence[str] = (), name: str = "labels",
                    block: int = BLOCK_ROWS) -> DataFrame:
    """Label of the row ``k`` rows ahead for every k in ``steps``, NONE past the end."""
    num = with_context(positions(df, keys, ts, tie), after=max(steps), block=block)
    w = block_window(keys)
    arr = F.array(*[F.lead(label, k, "NONE").over(w) for k in steps])
    return home(num.withColumn(name, arr)).drop("rn")


def max_label_within(df: DataFrame, keys: Sequence[str], ts: str, label: str,
                     rows: dict[str, int], tie: Sequence[str] = (),
                     block: int = BLOCK_ROWS) -> DataFrame:
    """Per output name, the highest class among the next ``h`` rows."""
    num = with_context(positions(df, keys, ts, tie), after=max(rows.values()), block=block)
    w = block_window(keys)
    sev = L.severity(F.col(label))
    return home(num.withColumns({
        name: L.class_of_severity(F.max(sev).over(w.rowsBetween(1, h)))
        for name, h in rows.items()})).drop("rn")


def clip_labels_ahead(df: DataFrame, keys: Sequence[str], ts: str, label: str, file: str,
                      n: int, step: int, horizons: dict[str, int], tie: Sequence[str] = (),
                      skip_incomplete: bool = True, block: int = BLOCK_ROWS) -> DataFrame:
    """Clips with the highest class in the rows after the last frame, per horizon.

    Incomplete clips at the end are dropped, or cut to the frames there are.
    """
    reach = (n - 1) * step
    num = with_context(positions(df, keys, ts, tie), after=reach + max(horizons.values()),
                       block=block)
    w = block_window(keys)
    sev = L.severity(F.col(label))
    num = num.withColumns({f"__{h}": F.max(sev).over(w.rowsBetween(1, r))
                           for h, r in horizons.items()})
    files = F.array(*[F.lead(file, k * step).over(w) for k in range(n)])
    picks = {h: F.array(*[F.lead(f"__{h}", k * step).over(w) for k in range(n)])
             for h in horizons}
    out = home(num.withColumns({"__f": files, **{f"__p_{h}": c for h, c in picks.items()}}))
    frames = F.filter("__f", lambda x: x.isNotNull())
    out = out.withColumn("filepaths", frames)
    if skip_incomplete:
        out = out.where(F.size("filepaths") == n)
    last = F.size("filepaths") - 1
    return out.select(*keys, ts, "rn", "filepaths", *[
        L.class_of_severity(F.get(f"__p_{h}", last)).alias(h) for h in horizons])


def label_at_offset(df: DataFrame, keys: Sequence[str], ts: str, label: str, offset: str,
                    file: str | None = None) -> DataFrame:
    """Label of the same entity's row exactly ``offset`` later, and how many different
    labels occur on the way (after this row, up to and including that one)."""
    pick = F.min(F.struct(F.col(file or label).alias("f"), F.col(label).alias("l")))
    future = df.groupBy(*keys, F.col(ts).alias("__t2")).agg(pick.alias("__f"))
    # a class occurs on the way iff its next occurrence is not past the offset
    nxt = running(df, keys, [ts], time_segment(ts), **{
        f"__n_{c}": ("following", F.when(F.col(label) == c, F.col(ts))) for c in L.LABELS})
    goal = F.col(ts) + interval(offset)
    seen = sum((F.coalesce(F.col(f"__n_{c}") <= goal, F.lit(False)).cast("long")
                for c in L.LABELS), F.lit(0).cast("long"))
    out = (nxt.withColumns({"__t2": goal, "n_labels": seen}).join(future, [*keys, "__t2"])
           .withColumn("future_label", F.col("__f.l")))
    if file:
        out = out.withColumn("filepath_future", F.col("__f.f"))
    return out.drop("__t2", "__f", *[f"__n_{c}" for c in L.LABELS])


def last_per_key(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """The latest row of each entity: a mergeable aggregate, not a sort of the entity."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(ts, *tie)
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("__r"))
            .select(*keys, "__r.*").select(*df.columns))


def select_items(df: DataFrame, keys: Sequence[str], ts: str, labels: Sequence[str] = (),
                 groups: Sequence = (), positions_at: Sequence[int] = (), tie: Sequence[str] = (),
                 last: bool = False) -> DataFrame:
    """Items by label, entity and position; empty lists mean no filter."""
    if labels:
        df = df.where(F.col("label").isin(*labels))
    if groups:
        df = df.where(F.col(keys[0]).isin(*groups))
    if positions_at:
        df = positions(df, keys, ts, tie).where(F.col("rn").isin(*positions_at)).drop("rn")
    return last_per_key(df, keys, ts, tie) if last else df


def clip_integrity(df: DataFrame, frames: str, step: str, tol: str = "1 second") -> DataFrame:
    """Gap check of the times in frame names: ``ok`` and the positions of bad gaps."""
    def off(t):
        return F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.abs(
            F.get(t, i) - F.get(t, i - 1) - interval_micros(step)) > interval_micros(tol))

    bad = let(F.transform(frames, lambda p: micros(file_time_any(p))),
              lambda t: F.transform(off(t), lambda i: i - 1))
    return (df.withColumn("bad_positions", bad)
            .withColumn("ok", F.size("bad_positions") == 0))
