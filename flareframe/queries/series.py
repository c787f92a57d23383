"""Series transforms and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flareframe.functions import arrays as A
from flareframe.operators import series as S
from flareframe.queries.inputs import r6, table
from flareframe.queries.registry import query

# embeddings as series: id, position, value; every 17th point of every third row is NaN
PTS = """pts AS (SELECT vec_id AS id, CAST(i - 1 AS BIGINT) AS pos, CASE WHEN vec_id % 3 = 0 AND i % 17 = 0 THEN 'nan'::DOUBLE ELSE CAST(v AS DOUBLE) END AS x
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
Z = PTS + ", z AS (SELECT id, pos, CASE WHEN isnan(x) THEN 0 ELSE x END AS x FROM pts)"


def vecs(spark, sf):
    e = table(spark, sf, "embeddings")
    x = F.transform("embedding", lambda v, i: F.when((F.col("vec_id") % 3 == 0) & ((i + 1) % 17 == 0),
                                                     F.lit(float("nan"))).otherwise(v.cast("double")))
    return e.select(F.col("vec_id").alias("id"), x.alias("x"), "label")


def points(df, col="x", digits=6, name="x"):
    return df.select("id", F.posexplode(col).alias("pos", "__v")).select(
        "id", F.col("pos").cast("long").alias("pos"), r6("__v", digits).alias(name))


@query("t03_zero_nonfinite", f"WITH {Z} SELECT id, pos, round(x, 6) + 0.0 AS x FROM z")
def _(spark, sf):
    return points(vecs(spark, sf).withColumn("x", A.zero_nonfinite(F.col("x"))))


@query("t04_log_stretch", f"""WITH {Z}, m AS (SELECT *, min(x) OVER (PARTITION BY id) AS lo FROM z)
SELECT id, pos, round(CASE WHEN x = lo THEN 0 ELSE log10(1 + x - lo) END, 6) + 0.0 AS x FROM m""")
def _(spark, sf):
    return points(S.load_series(vecs(spark, sf), ["x"], ["x"]))


@query("t05_minmax", f"""WITH {Z}, m AS (SELECT *, min(x) OVER (PARTITION BY id) AS lo, max(x) OVER (PARTITION BY id) AS hi FROM z)
SELECT id, pos, round(CASE WHEN hi = lo THEN 0.5 ELSE -1 + (x - lo) * (3 / (hi - lo)) END, 6) + 0.0 AS x FROM m""")
def _(spark, sf):
    d = S.load_series(vecs(spark, sf), ["x"])
    return points(d.withColumn("x", A.minmax(F.col("x"), -1.0, 2.0)))


MED = PTS + ", fin AS (SELECT * FROM pts WHERE NOT isnan(x))"


def _scaler(kind, stats, expr):
    sql = f"""WITH {MED}, st AS ({stats}) SELECT id, pos, round({expr}, 6) + 0.0 AS x FROM pts, st WHERE NOT isnan(x)"""

    @query(f"t06_apply_{kind}", sql)
    def _(spark, sf):
        d = vecs(spark, sf)
        st = S.fit_scaler(d, ["x"], kind)
        d = S.apply_scaler(d, ["x"], st, kind)
        return points(d).where(~F.isnan("x"))

    @query(f"a13_fit_{kind}", f"WITH {MED}, st AS ({stats}) SELECT 'x' AS var, round(a, 6) AS a, round(b, 6) AS b FROM st")
    def _(spark, sf):
        st = S.fit_scaler(vecs(spark, sf), ["x"], kind)
        return st.select("var", r6("a").alias("a"), r6("b").alias("b"))


_scaler("minmax", "SELECT min(x) AS a, max(x) AS b FROM fin", "(x - a) / (b - a)")
_scaler("zscore", "SELECT avg(x) AS a, stddev_pop(x) AS b FROM fin", "(x - a) / b")
_scaler("robust", "SELECT m AS a, 1.4826 * median(abs(x - m)) AS b FROM fin, (SELECT median(x) AS m FROM fin) GROUP BY m", "(x - a) / b")


@query("a12_series_stats", """WITH l AS (SELECT l_partkey, l_quantity, l_extendedprice FROM lineitem),
v AS (SELECT 'price' AS var, l_extendedprice AS x FROM l UNION ALL SELECT 'quantity', l_quantity FROM l)
SELECT var, round(min(x), 4) AS min, round(max(x), 4) AS max, round(avg(x), 4) AS mean, round(median(x), 4) AS median,
  round(stddev_samp(x), 4) AS data_std, CAST(1 AS BIGINT) AS npoints FROM v GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    d = li.select(F.array("l_extendedprice").alias("price"), F.array("l_quantity").alias("quantity"))
    s = S.series_stats(d, ["price", "quantity"], 1)
    return s.select("var", *[r6(c, 4).alias(c) for c in ("min", "max", "mean", "median", "data_std")], "npoints")


@query("a12_vector_stats", f"""WITH {Z}, m AS (SELECT *, min(x) OVER (PARTITION BY id) AS lo FROM z), v AS (SELECT CASE WHEN x = lo THEN 0 ELSE log10(1 + x - lo) END AS x FROM m)
SELECT 'x' AS var, round(min(x), 6) + 0.0 AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS data_std, CAST(64 AS BIGINT) AS npoints FROM v""")
def _(spark, sf):
    s = S.series_stats(vecs(spark, sf), ["x"], 64, ["x"])
    return s.select("var", *[r6(c).alias(c) for c in ("min", "max", "mean", "median", "data_std")], "npoints")


@query("a12_context_lengths", """WITH v AS (SELECT CASE WHEN vec_id % 4 = 0 THEN 60 WHEN vec_id % 11 = 0 THEN 0 ELSE len(embedding) END AS n FROM embeddings)
SELECT 'x' AS var, CAST(n AS BIGINT) AS npoints, count(*) AS n_series FROM v GROUP BY n""")
def _(spark, sf):
    d = vecs(spark, sf).withColumn("x", F.when(F.col("id") % 4 == 0, F.slice("x", 1, 60)).when(F.col("id") % 11 != 0, F.col("x")))
    return S.context_lengths(d, ["x"])


@query("t07_stack_channels", f"""WITH {Z}, l AS (SELECT id, list(x ORDER BY pos) AS xs FROM z WHERE id % 4 <> 0 GROUP BY 1),
s AS (SELECT id, unnest(range(len(xs))) AS pos, unnest(xs) AS a, unnest(list_reverse(xs)) AS b FROM l) SELECT id, pos, round(a, 6) + 0.0 AS c0, round(b, 6) + 0.0 AS c1 FROM s""")
def _(spark, sf):
    d = S.load_series(vecs(spark, sf), ["x"])
    other = F.when(F.col("id") % 4 == 0, F.slice(F.reverse("x"), 1, 60)).otherwise(F.reverse("x"))
    d = d.withColumn("t", A.stack_channels([F.col("x"), other]))
    return d.select("id", F.posexplode("t").alias("pos", "r")).select(
        "id", F.col("pos").cast("long").alias("pos"), r6(F.col("r")[0]).alias("c0"), r6(F.col("r")[1]).alias("c1"))


@query("t08_asinh_stretch", f"""WITH {Z}, u AS (SELECT id, pos, x * 10 AS x, min(x * 10) OVER (PARTITION BY id) AS lo, max(x * 10) OVER (PARTITION BY id) AS hi FROM z),
s AS (SELECT id, pos, (CASE WHEN hi > 1 THEN (x - lo) / (hi - lo + 1e-12) ELSE x END - 0.5) * 2 AS x FROM u),
q AS (SELECT id, quantile_cont(x, 0.02) AS ql, quantile_cont(x, 0.98) AS qh FROM s GROUP BY 1)
SELECT s.id, pos, round((asinh(least(greatest(x, ql), qh) / greatest(abs(ql), abs(qh)) / (0.5 + 1e-12)) / (asinh(1 / (0.5 + 1e-12)) + 1e-12) + 1) * 0.5, 6) + 0.0 AS x FROM s JOIN q USING (id)""")
def _(spark, sf):
    d = S.load_series(vecs(spark, sf), ["x"])
    d = d.withColumn("x", F.transform("x", lambda v: v * 10.0))
    return points(d.withColumn("x", A.asinh_stretch(F.col("x"), 2.0, 98.0, 0.5)))


@query("t09_rescale", f"""WITH {Z}, k AS (SELECT id, pos, CASE WHEN id % 5 = 0 THEN 0 WHEN id % 5 = 1 THEN 3 ELSE x END AS x FROM z),
m AS (SELECT *, min(x) OVER (PARTITION BY id) AS lo, max(x) OVER (PARTITION BY id) AS hi FROM k)
SELECT id, pos, round(CASE WHEN hi = lo THEN 10 ELSE (x - lo) / (hi - lo) * 10 + 10 END, 6) AS x FROM m WHERE NOT (lo = 0 AND hi = 0)""")
def _(spark, sf):
    k = F.col("id") % 5
    d = vecs(spark, sf).withColumn("x", F.transform("x", lambda v: F.when(k == 0, 0.0).when(k == 1, 3.0).otherwise(v)))
    return points(d.withColumn("x", A.rescale(F.col("x"), 10.0, 20.0)))


@query("t10_instance_scale", f"""WITH {MED}, m AS (SELECT id, avg(x) AS loc, var_pop(x) AS v FROM fin GROUP BY 1)
SELECT id, round(loc, 6) + 0.0 AS loc, round(sqrt(v + 1e-5), 6) AS scale FROM m""")
def _(spark, sf):
    seen = F.transform("x", lambda v: ~F.isnan(v))
    d = vecs(spark, sf).select("id", A.instance_scale(F.col("x"), seen).alias("s"))
    return d.select("id", r6("s.loc").alias("loc"), r6("s.scale").alias("scale"))


def two(spark, sf):
    d = S.load_series(vecs(spark, sf), ["x"])
    return d.withColumn("y", F.reverse("x"))


@query("t11_tokens_time_only", f"""WITH {Z}, c AS (SELECT a.id, a.pos, a.x AS v0, b.x AS v1 FROM z a JOIN z b ON a.id = b.id AND b.pos = 63 - a.pos WHERE a.pos < 60),
l AS (SELECT id, CAST(floor(pos / 10) AS BIGINT) AS token, (pos % 10) * 3 + k AS i, CASE k WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE 0 END AS x, k < 2 AS seen FROM c, (SELECT unnest([0, 1, 2]) AS k) q)
SELECT id, token, token AS time_id, CAST(0 AS BIGINT) AS variate_id, count(*) AS n, round(sum(x * (i + 1)), 6) + 0.0 AS checksum, count(CASE WHEN seen THEN 1 END) AS n_seen FROM l GROUP BY 1, 2""")
def _(spark, sf):
    return _tokens(S.patch_tokens(two(spark, sf), "id", ["x", "y"], 10, "time_only", channels=3))


def _tokens(t):
    check = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return t.select(F.col("sample_id").alias("id"), "token", F.col("time_id").cast("long").alias("time_id"),
                    F.col("variate_id").cast("long").alias("variate_id"), F.size("values").cast("long").alias("n"),
                    r6(check).alias("checksum"),
                    F.size(F.filter("observed", lambda o: o)).cast("long").alias("n_seen"))


def _variate(order, tok):
    sql = f"""WITH {Z}, c AS (SELECT a.id, a.pos, a.x AS v0, b.x AS v1 FROM z a JOIN z b ON a.id = b.id AND b.pos = 63 - a.pos WHERE a.pos < 60),
l AS (SELECT id, CAST(floor(pos / 10) AS BIGINT) AS time_id, CAST(k AS BIGINT) AS variate_id, pos % 10 AS i, CASE k WHEN 0 THEN v0 ELSE v1 END AS x FROM c, (SELECT unnest([0, 1]) AS k) q)
SELECT id, {tok} AS token, time_id, variate_id, count(*) AS n, round(sum(x * (i + 1)), 6) + 0.0 AS checksum, count(*) AS n_seen FROM l GROUP BY 1, 3, 4"""

    @query(f"t12_tokens_{order}", sql)
    def _(spark, sf):
        return _tokens(S.patch_tokens(two(spark, sf), "id", ["x", "y"], 10, "time_variate", order))


_variate("by_variate", "variate_id * 6 + time_id")
_variate("interleave_time", "time_id * 2 + variate_id")


@query("t13_masked_mean", f"""WITH {Z}, l AS (SELECT id, CAST(floor(pos / 8) AS BIGINT) AS token, CAST(pos % 8 AS BIGINT) AS dim, x FROM z)
SELECT id, dim, round(coalesce(sum(CASE WHEN (token + id) % 3 = 0 AND id % 7 <> 0 THEN x END), 0) / greatest(count(CASE WHEN (token + id) % 3 = 0 AND id % 7 <> 0 THEN 1 END), 1), 6) + 0.0 AS mean FROM l GROUP BY 1, 2""")
def _(spark, sf):
    d = S.load_series(vecs(spark, sf), ["x"])
    t = S.patch_tokens(d, "id", ["x"], 8)
    keep = ((F.col("token") + F.col("sample_id")) % 3 == 0) & (F.col("sample_id") % 7 != 0)
    m = S.masked_mean(t, "sample_id", "values", keep)
    return m.select(F.col("sample_id").alias("id"), F.col("dim").cast("long").alias("dim"), r6("mean").alias("mean"))


@query("t14_scoring_columns", f"""WITH {Z} SELECT id, pos AS time_id, round(x, 6) + 0.0 AS c0, CAST(64 AS BIGINT) AS n, true AS observed, false AS predicted FROM z""")
def _(spark, sf):
    d = S.load_series(vecs(spark, sf), ["x"])
    ok = S.scoring_columns(d.withColumn("target", F.array("x", F.reverse("x"))), "target")
    z = F.arrays_zip("target", "observed_mask", "time_id", "prediction_mask")
    return ok.select("id", F.size("target").cast("long").alias("n"), F.explode(z).alias("z")).select(
        "id", F.col("z.time_id").cast("long").alias("time_id"), r6(F.col("z.target")[0]).alias("c0"), "n",
        F.col("z.observed_mask")[0].alias("observed"), F.col("z.prediction_mask").alias("predicted"))


@query("t15_affine", """SELECT vec_id AS id, CAST(i AS BIGINT) AS pos, round((CAST(v AS DOUBLE) - i / CAST(128 AS DOUBLE)) / ((i + 1) / CAST(64 AS DOUBLE)), 6) + 0.0 AS x
FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    shift, scale = [i / 128 for i in range(64)], [(i + 1) / 64 for i in range(64)]        # one pair per channel
    return points(e.select(F.col("vec_id").alias("id"), A.affine(x, shift, scale).alias("x")))


@query("f09_require_matched", "SELECT vec_id AS id FROM embeddings WHERE label % 3 <> 0 AND vec_id % 5 <> 0")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    d = e.select(F.col("vec_id").alias("id"),
                 F.when(F.col("label") % 3 != 0, F.array(F.lit("f.png"))).otherwise(
                     F.array().cast("array<string>")).alias("filepaths"),
                 F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("flux"))
    return S.require_matched(d, "filepaths", ["flux"]).select("id")
