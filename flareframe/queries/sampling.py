"""Downsampling, splits, draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from flareframe.operators import sampling as M
from flareframe.operators import splits as S
from flareframe.queries.inputs import GROUPED, ORDERS, orders_items, table, u_sql
from flareframe.queries.registry import query
from flareframe.queries.sets import grouped
from flareframe.session import materialise


def half(spark, sf):
    """Half the number of orders: the total to downsample to."""
    return table(spark, sf, "orders").count() // 2


TARGETS = ORDERS + """, n AS (SELECT label, count(*) AS n FROM oi GROUP BY 1), tt AS (SELECT CAST(floor(sum(n) / 2) AS BIGINT) AS t, sum(n) AS total FROM n),
tg AS (SELECT label, n, CAST(CASE label WHEN 'NONE' THEN n - least(n, total - t)
  WHEN 'C' THEN n - least(n, greatest(total - t - (SELECT n FROM n WHERE label = 'NONE'), 0)) ELSE n END AS BIGINT) AS target FROM n, tt)"""


@query("d01_target_total", f"WITH {TARGETS} SELECT label, n, target FROM tg")
def _(spark, sf):
    return M.downsample_targets(orders_items(spark, sf), "label", target_total=half(spark, sf))


@query("d02_target_per_label", f"WITH {ORDERS} SELECT label, count(*) AS n, CAST(CASE label WHEN 'NONE' THEN least(2500, count(*)) WHEN 'M' THEN 0 ELSE count(*) END AS BIGINT) AS target FROM oi GROUP BY 1")
def _(spark, sf):
    return M.downsample_targets(orders_items(spark, sf), "label",
                                targets={"NONE": 2500, "C": 10 ** 9, "M": -3})


# keep plan per (label, group), written out independently
PLAN = f"""s AS (SELECT label, ar, count(*) AS size FROM oi GROUP BY 1, 2),
p0 AS (SELECT s.*, target AS t, count(*) OVER (PARTITION BY s.label) AS g, sum(size - 1) OVER (PARTITION BY s.label) AS resum FROM s JOIN tg USING (label)),
p1 AS (SELECT *, t >= g AS many, CASE WHEN t >= g AND resum > 0 THEN CAST(size - 1 AS DOUBLE) / CAST(resum AS DOUBLE) * (t - g) ELSE 0 END AS ideal FROM p0),
p2 AS (SELECT *, floor(ideal) AS fl, ideal - floor(ideal) AS rem FROM p1),
p3 AS (SELECT *, t - g - sum(fl) OVER (PARTITION BY label) AS lft, sum(rem) OVER (PARTITION BY label) AS remsum FROM p2),
p4 AS (SELECT *, CASE WHEN NOT many THEN CAST(size AS DOUBLE) WHEN remsum > 0 THEN rem ELSE CAST(size - 1 AS DOUBLE) END AS w FROM p3),
p5 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN w > 0 THEN -ln({u_sql(3, "label", "ar")}) / w ELSE 1e308::DOUBLE * (1 + {u_sql(3, "label", "ar")} / 2) END, label || ':' || ar) AS rk FROM p4),
plan AS (SELECT label, ar, size, t AS target, CAST(CASE WHEN many THEN least(size, 1 + fl + CASE WHEN resum > 0 AND rk <= lft THEN 1 ELSE 0 END)
  WHEN rk <= t THEN 1 ELSE 0 END AS BIGINT) AS keep_n FROM p5)"""
FEW = ORDERS + """, tg AS (SELECT label, CAST(300 AS BIGINT) AS target FROM oi GROUP BY 1), """ + PLAN
KEEP = TARGETS + ", " + PLAN + f""", rr AS (SELECT oi.*, row_number() OVER (PARTITION BY label, ar ORDER BY {u_sql(3, 'id')}, id) AS rk FROM oi),
kp AS (SELECT rr.id, rr.label, rr.ar, rr.rk <= plan.keep_n AS keep FROM rr JOIN plan USING (label, ar))"""


def plan_for(spark, sf, target=None):
    o = orders_items(spark, sf)
    goals = (M.downsample_targets(o, "label", target_total=half(spark, sf)) if target is None
             else M.downsample_targets(o, "label", targets=target))
    sizes = materialise(S.group_sizes(o, "label", "ar"))       # the plan reads it several times
    return M.keep_plan(sizes.join(goals.select("label", "target"), "label"), 3)


@query("d03_keep_plan", f"WITH {TARGETS}, {PLAN} SELECT label, ar, size, target, keep_n FROM plan")
def _(spark, sf):
    return plan_for(spark, sf)


@query("d03_fewer_than_groups", f"WITH {FEW} SELECT label, ar, size, target, keep_n FROM plan")
def _(spark, sf):
    return plan_for(spark, sf, {c: 300 for c in ("NONE", "C", "M", "X")})


@query("d04_weighted_sample", f"SELECT o_orderkey AS id FROM orders ORDER BY -ln({u_sql(5, 'o_orderkey')}) / o_totalprice, o_orderkey LIMIT 500")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return M.weighted_sample(o, "id", "o_totalprice", 500, 5).select("id")


@query("d05_sample_per_group", f"""WITH {ORDERS}, r AS (SELECT id, ar, row_number() OVER (PARTITION BY ar ORDER BY {u_sql(9, 'id')}, id) AS k FROM oi) SELECT id, ar FROM r WHERE k <= 3""")
def _(spark, sf):
    return M.sample_per_group(orders_items(spark, sf), ["ar"], "id", 3, 9).select("id", "ar")


def kept(spark, sf, label="label"):
    return M.downsample(orders_items(spark, sf), "id", "ar", label, target_total=half(spark, sf), seed=3)


@query("d06_plan_mismatch", "SELECT CAST(0 AS BIGINT) AS n_mismatch")
def _(spark, sf):
    return M.plan_mismatch(kept(spark, sf), plan_for(spark, sf)).agg(F.count(F.lit(1)).alias("n_mismatch"))


@query("d07_label_column", f"WITH {KEEP} SELECT label AS flare_type, keep, count(*) AS n FROM kp GROUP BY 1, 2")
def _(spark, sf):
    o = orders_items(spark, sf).withColumnRenamed("label", "flare_type")
    d = M.downsample(o, "id", "ar", "flare_type", target_total=half(spark, sf), seed=3)
    return d.groupBy("flare_type", "keep").agg(F.count(F.lit(1)).alias("n"))


@query("d08_keep_flag", f"WITH {KEEP} SELECT id, keep FROM kp")
def _(spark, sf):
    return kept(spark, sf).select("id", "keep")


@query("d09_before_after", f"WITH {KEEP} SELECT label, ar, count(*) AS n_before, count(CASE WHEN keep THEN 1 END) AS n_after, count(CASE WHEN keep THEN 1 END) = 0 AS lost FROM kp GROUP BY 1, 2")
def _(spark, sf):
    return M.before_after(kept(spark, sf), "label", "ar")


# plain stratified split 70/15/15, quotas half-even
QUOTA = ORDERS + """, qn AS (SELECT label, count(*) AS n FROM oi GROUP BY 1), qt AS (SELECT sum(n)::DOUBLE AS total FROM qn),
tot AS (SELECT total, round_even(total * 0.7, 0)::DOUBLE AS train_n, round_even(total * 0.15, 0)::DOUBLE AS cv_n FROM qt)"""
SPLIT = QUOTA + f""", q AS (SELECT label, n, round_even(n * (train_n / total), 0)::DOUBLE AS tq, round_even(n * (cv_n / total), 0)::DOUBLE AS cq, total - train_n - cv_n AS test_n FROM qn, tot),
r1 AS (SELECT oi.id, oi.label, test_n, row_number() OVER (PARTITION BY oi.label ORDER BY {u_sql('11:class', 'oi.id')}, oi.id) AS rk, tq, cq FROM oi JOIN q USING (label)),
r2 AS (SELECT id, label, test_n, CASE WHEN rk <= tq THEN 'train' WHEN rk <= tq + cq THEN 'cv' ELSE 'test' END AS split FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {u_sql('11:test', 'id')}, id) AS k FROM r2)"""
FRAC = (0.7, 0.15, 0.15)


@query("d10_stratified_split", f"WITH {SPLIT} SELECT id, label, CASE WHEN split = 'test' AND k > test_n THEN 'unused' ELSE split END AS split FROM r3")
def _(spark, sf):
    d = M.stratified_split(orders_items(spark, sf).drop("split"), "id", "label", FRAC, 11)
    return d.select("id", "label", "split")


# requested train sizes: far above the budget for NONE, so quotas are scaled down
WANT = {"NONE": 10 ** 9, "C": 500, "M": 500, "X": 100}
TQ = QUOTA + """, w AS (SELECT label, n, train_n, cv_n, total, least(CASE label WHEN 'NONE' THEN 1000000000 WHEN 'X' THEN 100 ELSE 500 END, n)::DOUBLE AS g FROM qn, tot),
w2 AS (SELECT *, CASE WHEN sum(g) OVER () > train_n THEN floor(g * (train_n / sum(g) OVER ())) ELSE g END AS tq FROM w),
w3 AS (SELECT *, least(round_even((n - tq) * (cv_n / sum(n - tq) OVER ()), 0)::DOUBLE, n - tq) AS cq FROM w2)"""


@query("d11_train_targets", f"WITH {TQ} SELECT label AS cls, n, CAST(tq AS BIGINT) AS train_q, CAST(cq AS BIGINT) AS cv_q FROM w3")
def _(spark, sf):
    q = M.split_quotas(orders_items(spark, sf), "label", FRAC, WANT)
    return q.select("cls", "n", "train_q", "cv_q")


OS = QUOTA + f""", big AS (SELECT label, n, CASE WHEN label = 'X' THEN n + 700 ELSE 0 END AS want FROM qn),
dr AS (SELECT label, n, unnest(generate_series(1, want - n)) AS copy FROM big WHERE want > n),
pick AS (SELECT label, copy, CAST(floor({u_sql('11:draw', 'label', 'copy')} * n) AS BIGINT) + 1 AS rk FROM dr),
pool AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {u_sql('11:class', 'id')}, id) AS rk FROM oi)"""


@query("d12_oversample_draws", f"WITH {OS} SELECT pool.id, pool.label, pick.copy FROM pick JOIN pool USING (label, rk)")
def _(spark, sf):
    o = orders_items(spark, sf).drop("split")
    n = o.where("label = 'X'").count()
    q = M.split_quotas(o, "label", FRAC, {"X": n + 700}, "oversample")
    return M.oversample_draws(o, "id", "label", q, 11).select("id", "label", "copy")


@query("d13_rest_to_cv_and_test", f"""WITH {TQ}, r1 AS (SELECT oi.id, oi.label, total - train_n - cv_n AS test_n, row_number() OVER (PARTITION BY oi.label ORDER BY {u_sql('11:class', 'oi.id')}, oi.id) AS rk, tq, cq
  FROM oi JOIN w3 USING (label)), r2 AS (SELECT id, label, test_n, CASE WHEN rk <= tq THEN 'train' WHEN rk <= tq + cq THEN 'cv' ELSE 'test' END AS split FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {u_sql('11:test', 'id')}, id) AS k FROM r2)
SELECT id, label, CASE WHEN split = 'test' AND k > test_n THEN 'unused' ELSE split END AS split FROM r3""")
def _(spark, sf):
    d = M.stratified_split(orders_items(spark, sf).drop("split"), "id", "label", FRAC, 11, WANT)
    return d.select("id", "label", "split")


@query("d14_group_split_cumulative", f"WITH {GROUPED} SELECT ar, size, split FROM gp")
def _(spark, sf):
    o = orders_items(spark, sf)
    return S.assign_cumulative(S.group_sizes(o, "ar"), "ar", {"train": 70, "cv": 15, "test": 15}, 42)


# 55/25/20 wanted of an assignment by 70/15/15
REBALANCED = f"""{GROUPED}, tt AS (SELECT sum(size) AS total FROM gp),
want AS (SELECT unnest(['train', 'cv', 'test']) AS split, unnest([CAST(floor(total * 0.55) AS BIGINT), CAST(floor(total * 0.25) AS BIGINT), CAST(floor(total * 0.2) AS BIGINT)]) AS goal, unnest([1, 2, 3]) AS k FROM tt),
hv AS (SELECT want.split, k, coalesce(sum(size), 0) - goal AS d FROM want LEFT JOIN gp ON gp.split = want.split GROUP BY want.split, k, goal),
lk AS (SELECT *, coalesce(sum(greatest(-d, 0)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(greatest(-d, 0)) OVER (ORDER BY k) AS hi FROM hv),
o1 AS (SELECT gp.ar, gp.size, gp.split, sum(size) OVER (PARTITION BY gp.split ORDER BY size, ar) <= d AS gone FROM gp JOIN hv ON gp.split = hv.split),
o2 AS (SELECT *, sum(CASE WHEN gone THEN size ELSE 0 END) OVER (ORDER BY size, ar) - size / 2.0 AS mid FROM o1),
rb AS (SELECT o2.ar, o2.size, coalesce(lk.split, o2.split) AS split FROM o2 LEFT JOIN lk ON o2.gone AND mid >= lo AND mid < hi)"""


@query("d15_rebalance", f"WITH {REBALANCED} SELECT ar, size, split FROM rb")
def _(spark, sf):
    o = orders_items(spark, sf)
    n = o.count()
    plan = S.assign_cumulative(S.group_sizes(o, "ar"), "ar", {"train": 70, "cv": 15, "test": 15}, 42)
    return S.rebalance(plan, "ar", {"train": n * 55 // 100, "cv": n // 4, "test": n // 5})


@query("d16_target_override", f"""WITH {ORDERS}, gs AS (SELECT ar, count(*) AS size FROM oi GROUP BY 1),
gu AS (SELECT ar, size, sum(size) OVER (ORDER BY {u_sql(1, 'ar')}, ar) AS cum, sum(size) OVER () AS total FROM gs),
gp AS (SELECT ar, size, CASE WHEN (cum - size / 2.0) / total < CAST(total // 2 AS DOUBLE) / total THEN 'train'
  WHEN (cum - size / 2.0) / total < CAST(total // 2 + total // 4 AS DOUBLE) / total THEN 'cv' ELSE 'test' END AS split FROM gu)
SELECT ar, split, size AS n FROM gp""")
def _(spark, sf):
    o = orders_items(spark, sf)
    n = o.count()
    want = S.default_targets(o, {"train": n // 2, "cv": n // 4, "test": n - n // 2 - n // 4})
    return S.group_split(o.drop("split"), "ar", want, 1).groupBy("ar", "split").agg(F.count(F.lit(1)).alias("n"))


@query("d08_null_label", f"WITH {ORDERS} SELECT count(*) AS n, count(*) AS kept FROM oi WHERE id % 7 = 0")
def _(spark, sf):
    o = orders_items(spark, sf).withColumn("label", F.when(F.col("id") % 7 != 0, F.col("label")))
    d = M.downsample(o, "id", "ar", "label", targets={"NONE": 10, "C": 5}, seed=3)
    return d.where("label IS NULL").agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("kept"))


@query("d17_group_integrity", f"WITH {ORDERS} SELECT count(*) AS n_items, count(DISTINCT ar) AS n_groups FROM oi")
def _(spark, sf):
    d = S.check_exclusive(grouped(spark, sf), "ar")
    return d.groupBy("ar").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_groups"))


@query("d18_weighted_bootstrap", f"""WITH c AS (SELECT p_partkey AS id, sum(p_size) OVER (ORDER BY p_partkey) - p_size AS lo, sum(p_size) OVER (ORDER BY p_partkey) AS hi, sum(p_size) OVER () AS total FROM part),
n AS (SELECT count(*) AS n FROM part), d AS (SELECT draw, {u_sql(13, 'draw')} AS u FROM (SELECT unnest(generate_series(1, (SELECT n FROM n))) AS draw) x)
SELECT draw, id FROM d JOIN c ON u * total >= lo AND u * total < hi""")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return M.weighted_bootstrap(p, "id", "p_size", p.count(), 13).select("draw", "id")


@query("d19_random_items", f"SELECT o_orderkey AS id FROM orders ORDER BY {u_sql(2, 'o_orderkey')}, o_orderkey LIMIT 25")
def _(spark, sf):
    return M.sample_k(orders_items(spark, sf), "id", 25, 2).select("id")
