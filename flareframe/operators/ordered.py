"""Ordered computations that stay parallel inside one key.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends a whole key to one task,
which fails when a single key holds a large share of the rows.  The helpers
here cut each key into *segments* along the order, work inside segments, and
carry one summary row per (key, segment) across segment borders:

* ``running``      running sum / last / next / max with unbounded reach
* ``number_rows``  exact row numbers
* ``with_context`` row blocks of bounded size with the neighbour rows that
  lag/lead/rows-between frames of bounded reach need

Segments must be monotone in the order: a row in a higher segment must not
sort before a row in a lower one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEG = "__seg"
BLOCK = "__block"
BLOCK_ROWS = 65536


def whole():
    """Window over everything, in one task: only for tables whose row count is fixed by a
    parameter (classes, ticks, splits), never for data rows."""
    return Window.partitionBy(F.lit(0))


def micros(col: Column | str) -> Column:
    """Microseconds since the epoch of a (UTC) timestamp with or without zone."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))


def time_segment(ts: str | Column, width: str = "1 hour") -> Column:
    """Segment id of a time order: index of the ``width`` bucket holding ``ts``."""
    return F.floor(micros(ts) / F.lit(interval_micros(width)))


_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
          "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def interval_micros(text: str) -> int:
    """'72 minutes' -> microseconds; fixed-length units only."""
    num, unit = text.split()
    return round(float(num) * _UNITS[unit.rstrip("s")])


def interval(text: str) -> Column:
    return F.expr(f"INTERVAL '{interval_micros(text) / 1e6:.6f}' SECOND")


def segment_count(df: DataFrame) -> int:
    """How many segments to cut into: several per shuffle partition, so that even a key
    with most of the rows spreads over all tasks.  A power of two."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(5, (4 * partitions - 1).bit_length())


def uniform_segment(df: DataFrame, u: str | Column) -> Column:
    """Segment id of a value spread over [0, 1]: equal slices."""
    n = segment_count(df)
    c = F.col(u) if isinstance(u, str) else u
    return F.least(F.greatest(F.floor(c * n), F.lit(0)), F.lit(n - 1))


def with_quantile_segment(df: DataFrame, value: str, n: int | None = None,
                          name: str = "__qseg") -> DataFrame:
    """Add a segment id from approximate quantiles of ``value`` (a number or time).

    Balanced whatever the distribution; the bounds need not be exact because
    any monotone cut is valid.  The ``n - 1`` bounds come from one mergeable
    sketch as a scalar subquery and are searched by bisection (log2 n
    comparisons per row).
    """
    n = n or segment_count(df)
    if n & (n - 1):
        raise ValueError("n must be a power of two")
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    bounds = df.agg(F.percentile_approx(value, probs, F.lit(10 * n))).scalar()
    steps = [F.lit(n >> i) for i in range(1, n.bit_length())]
    v = F.col(value)
    found = F.aggregate(
        F.array(*steps), F.lit(0),
        lambda acc, st: F.when(F.get(F.col("__bounds"), acc + st - 1) <= v, acc + st)
        .otherwise(acc))
    return df.withColumn("__bounds", bounds).withColumn(name, found).drop("__bounds")


def _with_segment(df: DataFrame, segment: Column) -> DataFrame:
    """Rows with a null order value sort first, so they go to the lowest segment."""
    return df.withColumn(SEG, F.coalesce(segment.cast("long"), F.lit(-(1 << 62))))


def _key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One struct key: null fields compare equal, so null keys keep their rows."""
    if not keys:
        return df, []
    return df.withColumn("__key", F.struct(*keys)), ["__key"]


_BACKWARD = ("next", "following")


def _frame(kind: str, keys: Sequence[str], order: Sequence[str], whole_part: bool = False):
    """Window of a running kind.  Frames that look ahead run over the reversed order:
    a frame that grows is one pass, a frame that shrinks is quadratic in Spark."""
    by = [F.desc_nulls_last(c) if kind in _BACKWARD else F.asc_nulls_first(c) for c in order]
    w = Window.partitionBy(*keys).orderBy(*by)
    exclusive = whole_part or kind in ("prev", "following")
    return w.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)


def _over(kind: str, value: Column, w) -> Column:
    if kind == "sum":
        return F.sum(value).over(w)
    if kind == "max":
        return F.max(value).over(w)
    if kind not in ("last", "prev", *_BACKWARD):
        raise ValueError(f"unknown running kind {kind!r}")
    return F.last(value, ignorenulls=True).over(w)


def _total(kind: str, value: Column, order: Sequence[str]) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    at = F.when(value.isNotNull(), at)
    return F.max_by(value, at) if kind in ("last", "prev") else F.min_by(value, at)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column,
            **specs: tuple[str, Column]) -> DataFrame:
    """Add running columns per key along ``order`` (ascending column names).

    ``specs`` maps an output name to (kind, value):

    ``sum``/``max``  over all rows up to and including this one
    ``last``/``prev``       last non-null value up to / strictly before this row
    ``next``/``following``  first non-null value from / strictly after this row

    Two shuffles of the rows' own size at most (one when already partitioned by
    key and segment) plus one of a row per (key, segment).
    """
    df, k = _key(df, keys)
    df = _with_segment(df, segment)
    local = df.withColumns({f"__l_{n}": _over(kind, v, _frame(kind, [*k, SEG], order))
                            for n, (kind, v) in specs.items()})

    totals = df.groupBy(*k, SEG).agg(
        *[_total(kind, v, order).alias(f"__t_{n}") for n, (kind, v) in specs.items()])
    carry = totals.select(*k, SEG, *[
        _over(kind, F.col(f"__t_{n}"), _frame(kind, k, [SEG], whole_part=True)).alias(f"__c_{n}")
        for n, (kind, _) in specs.items()])

    out = local.join(carry, [*k, SEG], "left")

    def joined(n: str, kind: str) -> Column:
        loc, car = F.col(f"__l_{n}"), F.col(f"__c_{n}")
        if kind == "sum":
            return F.when(car.isNull(), loc).otherwise(F.coalesce(loc, F.lit(0)) + car)
        return F.greatest(loc, car) if kind == "max" else F.coalesce(loc, car)

    out = out.withColumns({n: joined(n, kind) for n, (kind, _) in specs.items()})
    drop = [SEG, *k] + [f"__{p}_{n}" for n in specs for p in "lc"]
    return out.drop(*drop)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column,
                name: str = "rn", attach: DataFrame | None = None) -> DataFrame:
    """Exact 1-based row number per key along ``order``.

    ``attach`` is a table with one row per key; its other columns are added to
    the rows.  It rides on the small per-segment table, so the rows themselves
    are never shuffled by the bare key.
    """
    tab = None
    if attach is not None:
        extra = [c for c in attach.columns if c not in keys]
        tab = attach.select(F.struct(*keys).alias("__key"), *extra)
    df, k = _key(df, keys)
    df = _with_segment(df, segment)
    local = df.withColumn("__local", F.row_number().over(
        Window.partitionBy(*k, SEG).orderBy(*order)).cast("long"))
    sizes = df.groupBy(*k, SEG).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(*k, SEG, F.coalesce(F.sum("__n").over(
        Window.partitionBy(*k).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("__before"))
    if tab is not None:
        offsets = offsets.join(tab, "__key", "left")
    return (local.join(offsets, [*k, SEG])
            .withColumn(name, F.col("__local") + F.col("__before"))
            .drop(SEG, "__local", "__before", *k))


def with_context(df: DataFrame, rn: str = "rn", before: int = 0, after: int = 0,
                 block: int = BLOCK_ROWS) -> DataFrame:
    """Copy rows into blocks of at most ``block`` rows plus their context.

    Adds ``__block`` and ``__home``.  Inside a (key, ``__block``) partition
    ordered by ``rn``, frames reaching ``before`` rows back and ``after`` rows
    ahead are complete for every row with ``__home`` true; filter on it last.
    """
    block = max(block, before, after)
    pos = F.col(rn) - 1
    own = F.floor(pos / block)
    places = [own]
    if before:      # context of later rows
        places.append(F.floor((pos + before) / block))
    if after:       # context of earlier rows
        places.append(F.greatest(F.floor((pos - after) / block), F.lit(0)))
    return (df.withColumn(BLOCK, F.explode(F.array_distinct(F.array(*places))))
            .withColumn("__home", F.col(BLOCK) == own))


def block_window(keys: Sequence[str], rn: str = "rn"):
    return Window.partitionBy(*keys, BLOCK).orderBy(rn)


def home(df: DataFrame) -> DataFrame:
    return df.where("__home").drop("__home", BLOCK)
