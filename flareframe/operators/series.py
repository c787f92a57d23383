"""Statistics, scalers, tokens and pooling of series held as array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flareframe.functions.arrays import is_finite, let, log_stretch, nan_to_null, zero_nonfinite
from flareframe.operators.ordered import running, uniform_segment
from flareframe.session import materialise

MAD_FACTOR = 1.4826     # fixed value: MAD of a normal distribution to its standard deviation


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median",
                 accuracy: int = 10_000, few_keys: bool = False) -> DataFrame:
    """Exact median per key for groups of any size.

    A mergeable sketch brackets the middle ranks; one more pass counts the rows
    below the bracket and the distinct values inside it, which are few.  Where
    the sketch's bracket misses, the full range takes its place, so the answer
    never depends on the sketch's error.  ``few_keys`` says the caller bounds the
    number of keys (feature names); brackets are then broadcast.
    """
    def side(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if few_keys or not keys else t

    v = nan_to_null(F.col(value).cast("double"))
    k = list(keys) or ["__one"]
    d = df.select(*(keys or [F.lit(1).alias("__one")]), v.alias("__v")).where(F.col("__v").isNotNull())
    half = 4.0 / accuracy
    b = d.groupBy(*k).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__mn"),
                          F.max("__v").alias("__mx"), F.percentile_approx(
        "__v", F.array(F.lit(0.5 - half), F.lit(0.5 + half)), F.lit(accuracy)).alias("__q"))
    b = materialise(b.select(*k, "__mn", "__mx", F.col("__q")[0].alias("__lo"), F.col("__q")[1].alias("__hi"),
                             F.floor((F.col("__n") + 1) / 2).alias("__r1"),
                             (F.floor(F.col("__n") / 2) + 1).alias("__r2")))

    def counted(b: DataFrame) -> DataFrame:
        """Rows below the bracket as one count, inside it one count per distinct value."""
        m = d.join(side(b.select(*k, "__lo", "__hi")), k).where(F.col("__v") <= F.col("__hi"))
        inside = F.when(F.col("__v") >= F.col("__lo"), F.col("__v"))
        return materialise(m.groupBy(*k, inside.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
                           .join(side(b), k))

    t = counted(b)
    got = t.groupBy(*k).agg(F.sum("__c").alias("__to"), F.max("__r1").alias("__r1"), F.max("__r2").alias("__r2"),
                            F.coalesce(F.sum(F.when(F.col("__v").isNull(), F.col("__c"))), F.lit(0)).alias("__base"))
    missed = b.join(got.where("__base < __r1 AND __to >= __r2").select(*k), k, "left_anti").select(*k)
    if missed.take(1):
        wide = b.join(missed.withColumn("__m", F.lit(True)), k, "left")
        t = counted(wide.withColumn("__lo", F.when(F.col("__m"), F.col("__mn")).otherwise(F.col("__lo")))
                    .withColumn("__hi", F.when(F.col("__m"), F.col("__mx")).otherwise(F.col("__hi"))).drop("__m"))
    # the row of the counts below sorts first; values spread evenly over a bracket this narrow
    slice_ = (F.col("__v") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    seg = F.when(F.col("__v").isNull(), F.lit(-1)).otherwise(uniform_segment(t, F.coalesce(slice_, F.lit(0.0))))
    cum = running(t, k, ["__v"], seg, __cum=("sum", F.col("__c")))

    def at(r: str) -> Column:
        return F.min(F.when(F.col("__cum") >= F.col(r), F.col("__v")))

    out = cum.groupBy(*k).agg(((at("__r1") + at("__r2")) / 2).alias(name))
    return out.select(*keys, name)


def load_series(df: DataFrame, cols: Sequence[str], log: Sequence[str] = ()) -> DataFrame:
    """Series ready for use: non-finite points 0, chosen ones log-stretched."""
    out = {}
    for c in cols:
        a = zero_nonfinite(F.col(c).cast("array<double>"))
        out[c] = zero_nonfinite(log_stretch(a)) if c in log else a
    return df.withColumns(out)


def same_length(df: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """Rows whose series all have exactly ``n`` points."""
    for c in cols:
        df = df.where(F.size(c) == n)
    return df


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(var, value) rows of several array columns."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("var"), F.col(c).cast("array<double>").alias("a"))
        for c in cols])).alias("s")).select("s.var", F.explode("s.a").alias("value"))


def series_stats(df: DataFrame, cols: Sequence[str], n: int,
                 log: Sequence[str] = ()) -> DataFrame:
    """Per variable over all points of all series of ``n`` points: min, max, mean,
    median, sample standard deviation and the context length."""
    df = load_series(df, cols, log)
    kept = df.select(*[F.when(F.size(c) == n, F.col(c)).alias(c) for c in cols])
    pts = _long(kept, cols)
    s = pts.groupBy("var").agg(F.min("value").alias("min"), F.max("value").alias("max"),
                               F.avg("value").alias("mean"),
                               F.stddev_samp("value").alias("data_std"))
    return s.join(exact_median(pts, ["var"], "value", few_keys=True), "var") \
        .withColumn("npoints", F.lit(n).cast("long"))


def context_lengths(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The lengths that occur in the data: (var, npoints, n_series); null series count as length 0.

    One length per variable means that the series share a context; several, that they must be cut or padded first.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("var"), F.coalesce(F.size(c), F.lit(0)).cast("long").alias("npoints"))
                               for c in cols]))
    return (df.select(each.alias("s")).groupBy("s.var", "s.npoints")
            .agg(F.count(F.lit(1)).alias("n_series")))


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    """Global statistics per feature: ``minmax`` (a=min, b=max), ``zscore`` (a=mean,
    b=population std) or ``robust`` (a=median, b=1.4826 MAD); b of 0 becomes 1 except
    for minmax.  Write the result to keep it for later data."""
    pts = _long(df, cols).withColumn("value", nan_to_null(F.col("value"))) \
        .where(F.col("value").isNotNull())
    if kind == "minmax":
        return pts.groupBy("var").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    if kind == "zscore":
        s = pts.groupBy("var").agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("b"))
    elif kind == "robust":
        med = materialise(exact_median(pts, ["var"], "value", "a", few_keys=True))
        dev = pts.join(F.broadcast(med), "var").withColumn("__d", F.abs(F.col("value") - F.col("a")))
        mad = exact_median(dev, ["var"], "__d", "b", few_keys=True).withColumn("b", F.col("b") * MAD_FACTOR)
        s = med.join(mad, "var")
    else:
        raise ValueError("kind is 'minmax', 'zscore' or 'robust'")
    return s.withColumn("b", F.when(F.col("b") > 0, F.col("b")).otherwise(F.lit(1.0)))


def apply_scaler(df: DataFrame, cols: Sequence[str], stats: DataFrame, kind: str,
                 lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Scale each feature with fitted statistics (one row per feature, carried as a map).

    Without statistics zscore and robust pass the series through; minmax gives
    the midpoint, as it does for a constant feature.
    """
    m = stats.where(F.col("var").isin(*cols)).agg(F.map_from_entries(F.collect_list(
        F.struct("var", F.struct("a", "b"))))).scalar()
    df = df.withColumn("__stats", m)

    def scaled(c: str) -> Column:
        def one(s: Column) -> Column:
            a, b, x = s["st"]["a"], s["st"]["b"], s["x"]
            if kind == "minmax":
                flat = a.isNull() | b.isNull() | (a == b)
                return F.transform(x, lambda v: F.when(flat, F.lit((lo + hi) / 2)).otherwise(
                    lo + (v - a) * (F.lit(hi - lo) / F.nullif(b - a, F.lit(0.0)))))
            return F.when(a.isNull(), x).otherwise(F.transform(x, lambda v: (v - a) / b))

        return let(F.struct(F.try_element_at(F.col("__stats"), F.lit(c)).alias("st"),
                            F.col(c).cast("array<double>").alias("x")), one)

    return df.withColumns({c: scaled(c) for c in cols}).drop("__stats")


def patch_tokens(df: DataFrame, id: str, cols: Sequence[str], patch: int,
                 mode: str = "time_variate", order: str = "by_variate",
                 channels: int | None = None) -> DataFrame:
    """Series cut into tokens of ``patch`` steps, the tail shorter than a patch dropped.

    ``time_only``: one token per patch, all channels mixed step by step, padded
    with zeros (unobserved) or cut to ``channels``.  ``time_variate``: one token
    per patch and variate, numbered by variate or interleaved in time.  Columns:
    sample_id, token, time_id, variate_id, values, observed.
    """
    c = len(cols)
    shortest = F.size(cols[0]) if c == 1 else F.least(*[F.size(x) for x in cols])
    n = F.floor(shortest / patch)
    d = df.select(F.col(id).alias("sample_id"), *cols, n.cast("int").alias("__n")) \
        .where("__n > 0")
    t = F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("time_id")
    if mode == "time_only":
        want = channels or c
        used = list(cols)[:want]
        pad = want - len(used)
        d = d.select("sample_id", *used, t)
        step = F.sequence(F.lit(0), F.lit(patch - 1))

        def row(i: Column) -> Column:
            at = F.col("time_id") * patch + i
            return F.array(*[F.get(F.col(x).cast("array<double>"), at) for x in used],
                           *[F.lit(0.0)] * pad)

        seen = F.array(*[F.lit(True)] * len(used), *[F.lit(False)] * pad)
        return d.select("sample_id", F.col("time_id").cast("long").alias("token"), "time_id",
                        F.lit(0).alias("variate_id"), F.flatten(F.transform(step, row)).alias("values"),
                        F.flatten(F.transform(step, lambda i: seen)).alias("observed"))
    if mode != "time_variate":
        raise ValueError("mode is 'time_only' or 'time_variate'")
    v = F.explode(F.array(*[F.struct(F.lit(i).alias("variate_id"),
                                     F.col(x).cast("array<double>").alias("a"))
                            for i, x in enumerate(cols)])).alias("x")
    d = d.select("sample_id", "__n", v).select("sample_id", "__n", "x.*")
    d = d.select("sample_id", "__n", "variate_id", "a", t)
    tok = (F.col("variate_id") * F.col("__n") + F.col("time_id") if order == "by_variate"
           else F.col("time_id") * c + F.col("variate_id"))
    return d.select("sample_id", tok.cast("long").alias("token"), "time_id", "variate_id",
                    F.slice("a", F.col("time_id") * patch + 1, F.lit(patch)).alias("values"),
                    F.array_repeat(F.lit(True), patch).alias("observed"))


def masked_mean(tokens: DataFrame, id: str, value: str, mask: Column) -> DataFrame:
    """Mean token vector per sample over the tokens with ``mask`` true, in long form
    (sample, dim, mean); a sample without any gets zeros."""
    m = mask.cast("double")
    d = tokens.select(id, m.alias("__m"), F.posexplode(value).alias("dim", "__v"))
    return d.groupBy(id, "dim").agg(
        (F.sum(F.col("__v") * F.col("__m")) / F.greatest(F.sum("__m"), F.lit(1.0))).alias("mean"))


def scoring_columns(df: DataFrame, target: str) -> DataFrame:
    """Inputs of a scoring model per row: target as [time][channel] (transposed when it
    has fewer rows than columns), masks and ids."""
    def oriented(x: Column) -> Column:
        t, c = F.size(x), F.size(F.get(x, F.lit(0)))
        return F.when(t < c, F.transform(F.sequence(F.lit(0), F.greatest(c - 1, F.lit(0))),
                                         lambda j: F.transform(x, lambda r: F.get(r, j)))).otherwise(x)

    df = df.withColumn(target, let(F.col(target), oriented))
    n = F.size(target)
    return df.withColumns({
        "observed_mask": F.transform(target, lambda r: F.transform(r, lambda _: F.lit(True))),
        "sample_id": F.array_repeat(F.lit(0), n),
        "time_id": F.transform(target, lambda _, i: i),
        "variate_id": F.array_repeat(F.lit(0), n),
        "prediction_mask": F.array_repeat(F.lit(False), n)})


def require_matched(df: DataFrame, frames: str, variables: Sequence[str]) -> DataFrame:
    """Rows with at least one frame and every series present."""
    ok = F.size(F.coalesce(F.col(frames), F.array().cast("array<string>"))) > 0
    for v in variables:
        ok = ok & F.col(v).isNotNull()
    return df.where(ok)


__all__ = ["exact_median", "load_series", "same_length", "series_stats", "fit_scaler",
           "apply_scaler", "patch_tokens", "masked_mean", "scoring_columns", "require_matched",
           "is_finite"]
