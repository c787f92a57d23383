"""Counts, shares, across-run statistics, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from flareframe.operators import reports as R
from flareframe.operators import splits as S
from flareframe.operators import weights as W
from flareframe.operators.sampling import uniform
from flareframe.queries.inputs import (CLASSES, ITEMS, ORDERS, classes, items, orders_items, r6, table,
                                       u_sql)
from flareframe.queries.registry import query


@query("a03_count_by_label", f"WITH {ORDERS} SELECT label, count(*) AS n FROM oi GROUP BY 1")
def _(spark, sf):
    return R.class_counts(orders_items(spark, sf), "label")


@query("a04_count_and_share", f"""WITH {ORDERS}, c AS (SELECT split, label, count(*) AS n FROM oi GROUP BY 1, 2)
SELECT split, label, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY split), 6) AS frac FROM c""")
def _(spark, sf):
    c = S.composition(orders_items(spark, sf), "label", ["split"])
    return c.withColumn("frac", r6("frac"))


@query("a04_collapsed_share", f"""WITH {ORDERS}, c AS (SELECT CASE label WHEN 'NONE' THEN 'NONE' WHEN 'C' THEN 'OTHER' ELSE 'M+' END AS label, count(*) AS n FROM oi GROUP BY 1)
SELECT label, n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS frac FROM c""")
def _(spark, sf):
    c = S.composition(orders_items(spark, sf), "label", collapsed=True)
    return c.withColumn("frac", r6("frac"))


@query("a05_group_sizes", f"WITH {ORDERS} SELECT label, ar, count(*) AS size FROM oi GROUP BY 1, 2")
def _(spark, sf):
    return S.group_sizes(orders_items(spark, sf), "label", "ar")


def run_splits(spark, sf):
    """Split composition of five seeds: run, category, split, label, n, frac."""
    o = orders_items(spark, sf).drop("split")
    d = o.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(5))))
    u = uniform("run", "run", "ar")
    d = d.withColumn("split", F.when(u < 0.7, "train").when(u < 0.85, "cv").otherwise("test"))
    c = S.composition(d, "label", ["run", "split"])
    return c.select("run", F.lit("per_label").alias("category"), "split", "label", "n", "frac")


RUNS = ORDERS + f""", rs AS (SELECT r.run, label, CASE WHEN {u_sql('run', 'r.run', 'ar')} < 0.7 THEN 'train' WHEN {u_sql('run', 'r.run', 'ar')} < 0.85 THEN 'cv' ELSE 'test' END AS split
  FROM oi, (SELECT unnest([1, 2, 3, 4, 5]) AS run) r),
rc0 AS (SELECT run, split, label, count(*) AS n FROM rs GROUP BY 1, 2, 3),
rc AS (SELECT run, split, label, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY run, split) AS frac FROM rc0)"""
STATS = "count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(coalesce(stddev_samp(v), 0), 6) AS std"


@query("a07_across_runs", f"""WITH {RUNS}, v AS (SELECT split, label, 'count' AS metric, CAST(n AS DOUBLE) AS v FROM rc UNION ALL SELECT split, label, 'frac', frac FROM rc)
SELECT 'per_label' AS category, split, label, metric, {STATS} FROM v GROUP BY 2, 3, 4""")
def _(spark, sf):
    a = R.across_runs(run_splits(spark, sf))
    return a.select("category", "split", "label", "metric", "n",
                    *[r6(c).alias(c) for c in ("min", "max", "mean", "median", "std")])


@query("a07_missing_as_zero", f"""WITH {RUNS}, big AS (SELECT * FROM rc WHERE NOT (label = 'X' AND run > 3)),
f AS (SELECT r.run, k.split, k.label FROM (SELECT DISTINCT split, label FROM big) k, (SELECT DISTINCT run FROM big) r),
z AS (SELECT f.split, f.label, coalesce(n, 0) AS n, coalesce(frac, 0) AS frac FROM f LEFT JOIN big USING (run, split, label)),
v AS (SELECT split, label, 'count' AS metric, CAST(n AS DOUBLE) AS v FROM z UNION ALL SELECT split, label, 'frac', frac FROM z)
SELECT 'per_label' AS category, split, label, metric, {STATS} FROM v GROUP BY 2, 3, 4""")
def _(spark, sf):
    d = run_splits(spark, sf).where(~((F.col("label") == "X") & (F.col("run") > 3)))
    a = R.across_runs(d, missing_as_zero=True)
    return a.select("category", "split", "label", "metric", "n",
                    *[r6(c).alias(c) for c in ("min", "max", "mean", "median", "std")])


@query("a09_group_placements", f"""WITH {ORDERS} SELECT ar, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) AS n_splits FROM oi GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def _(spark, sf):
    v = S.violations(orders_items(spark, sf), "ar")
    return v.select("ar", F.array_join("splits", ",").alias("splits"), F.col("n_splits").cast("long").alias("n_splits"))


@query("a10_reason_counts", """SELECT CASE WHEN year(o_orderdate) IN (1994, 1996) THEN 'year' WHEN o_totalprice < 50000 THEN 'coverage'
  WHEN o_orderstatus = 'P' THEN 'background' ELSE 'ok' END AS reason, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    reason = R.first_reason([("year", F.year("o_orderdate").isin(1994, 1996)),
                             ("coverage", F.col("o_totalprice") < 50000),
                             ("background", F.col("o_orderstatus") == "P")])
    return R.reason_counts(o.withColumn("reason", reason))


@query("a11_label_agreement", f"""WITH {ITEMS}, z AS (SELECT CASE WHEN id % 11 = 0 THEN NULL WHEN flare_type IN ('A', 'B') THEN 'NONE' ELSE flare_type END AS a,
  CASE WHEN value > 60 THEN 'X' WHEN value > 30 THEN 'M' ELSE 'NONE' END AS b FROM items)
SELECT count(CASE WHEN a = b THEN 1 END) AS n_equal, count(CASE WHEN a <> b THEN 1 END) AS n_diff, count(CASE WHEN a IS NULL THEN 1 END) AS n_missing FROM z""")
def _(spark, sf):
    d = items(spark, sf).select(
        F.when(F.col("id") % 11 != 0, F.concat("flare_type", F.lit("+"))).alias("a"),
        F.when(F.col("value") > 60, "X").when(F.col("value") > 30, "M").otherwise("NONE").alias("b"))
    return R.label_agreement(d, "a", "b")


@query("a14_group_distribution", f"""WITH {ORDERS}, c AS (SELECT split, ar, count(*) AS n FROM oi GROUP BY 1, 2)
SELECT split, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, min(n) AS n_min, max(n) AS n_max, round(avg(n), 6) AS n_mean FROM c GROUP BY 1""")
def _(spark, sf):
    return R.distribution(orders_items(spark, sf), "ar", ["split"]).withColumn("n_mean", r6("n_mean"))


# four ordered classes of all orders: id of the class label
OY = ORDERS + ", oy AS (SELECT id, CASE label WHEN 'X' THEN 3 WHEN 'M' THEN 2 WHEN 'C' THEN 1 ELSE 0 END AS y FROM oi)"
CC = OY + """, c5 AS (SELECT k.y, CAST(count(oy.y) AS DOUBLE) AS n FROM (SELECT unnest([0, 1, 2, 3, 4]) AS y) k LEFT JOIN oy ON oy.y = k.y GROUP BY 1)"""


def order_classes(spark, sf):
    from flareframe.functions import labels as L
    return orders_items(spark, sf).select("id", L.lookup(L.LABEL_ID, F.col("label")).alias("y"))


def _weights(scheme, w, normalize):
    norm = f"{w} * 5 / sum({w}) OVER ()" if normalize else w
    sql = f"""WITH {CC}, t AS (SELECT y, n, greatest(n, 1) AS s, sum(n) OVER () AS total, max(n) OVER () AS mx FROM c5)
SELECT CAST(y AS BIGINT) AS y, n, round({norm}, 8) AS weight FROM t"""

    @query(f"a15_class_weights_{scheme}{'' if normalize else '_raw'}", sql)
    def _(spark, sf):
        d = W.class_weights(order_classes(spark, sf), "y", 5, scheme, normalize)
        return d.withColumn("weight", r6("weight", 8))


for _s, _w in (("balanced", "(total / (5 * s))"), ("inverse", "(1 / s)"), ("inverse_v2", "(mx / s)")):
    for _n in (True, False):
        _weights(_s, _w, _n)


@query("a15_pos_weight", f"""WITH {CLASSES} SELECT count(CASE WHEN y = 1 THEN 1 END) AS n_pos, count(CASE WHEN y <> 1 THEN 1 END) AS n_neg,
  round((count(CASE WHEN y <> 1 THEN 1 END) + 1.0) / (count(CASE WHEN y = 1 THEN 1 END) + 1.0), 6) AS pos_weight FROM classes""")
def _(spark, sf):
    return W.pos_weight(classes(spark, sf), "y").withColumn("pos_weight", r6("pos_weight"))


@query("a16_ordinal_pos_weight", f"""WITH {CC}, t AS (SELECT y, sum(n) OVER (ORDER BY y DESC) AS n_pos, sum(n) OVER () AS total FROM c5)
SELECT CAST(y AS BIGINT) AS threshold, n_pos, total - n_pos AS n_neg, round(least((total - n_pos) / greatest(n_pos, 1e-12), 20), 6) AS pos_weight FROM t WHERE y >= 1""")
def _(spark, sf):
    return W.ordinal_pos_weight(order_classes(spark, sf), "y", 5, clip=20.0) \
        .withColumn("pos_weight", r6("pos_weight"))


@query("a17_sample_weights", f"""WITH {CC}, t AS (SELECT y, sum(n) OVER () / (5 * greatest(n, 1)) AS w FROM c5)
SELECT id, round(w * 5 / s, 6) AS sample_weight FROM oy JOIN (SELECT y, w, sum(w) OVER () AS s FROM t) t USING (y)""")
def _(spark, sf):
    d = W.sample_weights(order_classes(spark, sf), "y", 5)
    return d.select("id", r6("sample_weight").alias("sample_weight"))


@query("a17_weight_summary", f"""WITH {CC}, t AS (SELECT y, 1 / greatest(n, 1) AS w FROM c5), s AS (SELECT w FROM oy JOIN t USING (y))
SELECT round(min(w), 8) AS w_min, round(max(w), 8) AS w_max, round(avg(w), 8) AS w_mean FROM s""")
def _(spark, sf):
    d = W.sample_weights(order_classes(spark, sf), "y", 5, "inverse", normalize=False)
    s = W.weight_summary(d)
    return s.select(*[r6(c, 8).alias(c) for c in s.columns])


@query("a18_focal_alpha", f"""WITH {CC}, t AS (SELECT y, n, pow(1 / least(greatest(n / greatest(sum(n) OVER (), 1), 1e-8), 1), 0.5) AS inv FROM c5),
a AS (SELECT y, n, inv / avg(inv) OVER () AS a FROM t)
SELECT CAST(y AS BIGINT) AS y, n, round(greatest(least(a, (SELECT median(a) FROM a) * 10), 1e-6), 6) AS alpha FROM a""")
def _(spark, sf):
    return W.focal_alpha(order_classes(spark, sf), "y", 5).withColumn("alpha", r6("alpha"))
