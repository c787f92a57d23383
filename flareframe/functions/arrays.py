"""Transforms of fixed-length series held as array columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of ``value`` computed once.

    Inside a lambda an outer expression would be evaluated again for every
    element; binding it as the element of a one-item array avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def span(a: Column) -> Column:
    """struct(a, lo, hi): an array with its extremes."""
    return let(a, lambda v: F.struct(v.alias("a"), F.array_min(v).alias("lo"),
                                     F.array_max(v).alias("hi")))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def field_of(a: Column | str, name: str) -> Column:
    """Array of one field of an array of structs."""
    return F.transform(a, lambda x: x[name])


def nan_to_null(x: Column) -> Column:
    """Missing is null, never NaN: NaN would poison averages and maxima."""
    return F.when(~F.isnan(x), x)


def zero_nonfinite(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(is_finite(x), x).otherwise(F.lit(0.0)))


def log_stretch(a: Column) -> Column:
    """0 at the minimum, log10(1 + x - min) elsewhere."""
    return let(span(a), lambda s: F.transform(s["a"], lambda x: F.when(x == s["lo"], F.lit(0.0))
               .otherwise(F.log10(1.0 + x - s["lo"]))))


def minmax(a: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Series to [lo, hi]; a constant series goes to the midpoint."""
    return let(span(a), lambda s: F.transform(s["a"], lambda x: F.when(
        s["hi"] == s["lo"], F.lit((lo + hi) / 2)).otherwise(
        lo + (x - s["lo"]) * (F.lit(hi - lo) / F.nullif(s["hi"] - s["lo"], F.lit(0.0))))))


def rescale(a: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Like ``minmax`` after zeroing non-finite values; null if nothing but zeros is
    left, and a constant goes to ``lo``."""
    return let(span(zero_nonfinite(a)), lambda s: F.when(
        (s["lo"] != 0) | (s["hi"] != 0), F.transform(s["a"], lambda x: F.when(
            s["hi"] == s["lo"], F.lit(lo)).otherwise(
            (x - s["lo"]) / F.nullif(s["hi"] - s["lo"], F.lit(0.0)) * (hi - lo) + lo))))


def stack_channels(cols: Sequence[Column]) -> Column:
    """Equal-length series to one [time][channel] array; null when lengths differ."""
    same = F.lit(True)
    for c in cols[1:]:
        same = same & (F.size(c) == F.size(cols[0]))
    names = [f"c{i}" for i in range(len(cols))]
    zipped = F.arrays_zip(*[c.alias(n) for c, n in zip(cols, names)])
    return F.when(same, F.transform(zipped, lambda z: F.array(*[z[n] for n in names])))


def percentile(a: Column, q: float) -> Column:
    """Linear-interpolation percentile (q in 0..100) of one array."""
    pos = F.lit(q / 100.0) * (F.size(a) - 1)

    def pick(s: Column) -> Column:
        at = s["pos"]
        below = F.get(s["sorted"], F.floor(at).cast("int"))
        above = F.get(s["sorted"], F.ceil(at).cast("int"))
        return below + (above - below) * (at - F.floor(at))

    return let(F.struct(F.sort_array(a).alias("sorted"), pos.alias("pos")), pick)


def asinh_stretch(a: Column, pmin: float = 0.5, pmax: float = 99.5, scale: float = 0.5) -> Column:
    """Signed asinh compression around mid-range, clipped at two percentiles, in [0, 1]."""
    s = scale + 1e-12
    norm = math.asinh(1.0 / s) + 1e-12

    def signed(t: Column) -> Column:
        return F.transform(t["a"], lambda x: (F.when(
            t["hi"] > 1.0, (x - t["lo"]) / (t["hi"] - t["lo"] + 1e-12)).otherwise(x) - 0.5) * 2.0)

    def clipped(x: Column) -> Column:
        return F.struct(x.alias("x"), percentile(x, pmin).alias("lo"), percentile(x, pmax).alias("hi"))

    def squeeze(t: Column) -> Column:
        m = F.greatest(F.abs(t["lo"]), F.abs(t["hi"]))
        return F.transform(t["x"], lambda x: (F.when(m > 0, F.asinh(
            F.least(F.greatest(x, t["lo"]), t["hi"]) / F.nullif(m, F.lit(0.0)) / s) / norm)
            .otherwise(F.lit(0.0)) + 1.0) * 0.5)

    return let(let(let(span(a), signed), clipped), squeeze)


def instance_scale(values: Column, mask: Column, min_scale: float = 1e-5) -> Column:
    """struct(loc, scale) over observed points: mean and sqrt(variance + min_scale)."""
    kept = F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")),
                                lambda z: z["m"]), lambda z: z["v"].cast("double"))

    def centre(k: Column) -> Column:
        n = F.greatest(F.size(k), F.lit(1))
        return F.struct(k.alias("k"), n.alias("n"), (F.aggregate(
            k, F.lit(0.0), lambda acc, x: acc + x) / n).alias("loc"))

    def spread(t: Column) -> Column:
        var = F.aggregate(t["k"], F.lit(0.0),
                          lambda acc, x: acc + (x - t["loc"]) * (x - t["loc"])) / t["n"]
        return F.struct(t["loc"].alias("loc"), F.sqrt(var + min_scale).alias("scale"))

    return let(let(kept, centre), spread)


def affine(a: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """Per-channel (x - mean) / std."""
    m = F.array(*[F.lit(float(x)) for x in mean])
    s = F.array(*[F.lit(float(x)) for x in std])
    return F.transform(F.arrays_zip(a.alias("x"), m.alias("m"), s.alias("s")),
                       lambda z: (z["x"] - z["m"]) / z["s"])


def regular(times: Column, every: str) -> Column:
    """True when successive times of an array are exactly ``every`` apart."""
    from flareframe.operators.ordered import interval
    step = interval(every)
    return let(times, lambda t: F.forall(
        F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))),
        lambda i: (F.size(t) < 2) | (F.get(t, i) == F.get(t, i - 1) + step)))
