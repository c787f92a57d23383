"""Joins, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from flareframe.operators import reports as R
from flareframe.operators import splits as S
from flareframe.queries.inputs import GROUPED, ITEMS, ORDERS, items, orders_items, table, u_sql
from flareframe.queries.registry import query


def grouped(spark, sf):
    """The order items re-split by customer."""
    return S.group_split(orders_items(spark, sf).drop("split"), "ar",
                         {"train": 70, "cv": 15, "test": 15}, 42)


@query("j07_semi_join", "SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, sf):
    allow = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("ar"))
    return orders_items(spark, sf).join(allow, "ar", "left_semi").select("id")


@query("j08_compare_composition", f"""WITH {GROUPED},
a AS (SELECT split, label, count(*) AS n FROM oi WHERE NOT (split = 'cv' AND label = 'X') GROUP BY 1, 2),
b AS (SELECT split, label, count(*) AS n FROM ni WHERE NOT (split = 'test' AND label = 'C') GROUP BY 1, 2)
SELECT coalesce(a.split, b.split) AS split, coalesce(a.label, b.label) AS label, coalesce(a.n, 0) AS orig_n, coalesce(b.n, 0) AS new_n FROM a FULL JOIN b ON a.split = b.split AND a.label = b.label""")
def _(spark, sf):
    old = orders_items(spark, sf).where("NOT (split = 'cv' AND label = 'X')")
    new = grouped(spark, sf).where("NOT (split = 'test' AND label = 'C')")
    return S.compare_composition(old, new, "label").select("split", "label", "orig_n", "new_n")


@query("j09_attach_assignment", f"WITH {GROUPED} SELECT id, split FROM ni")
def _(spark, sf):
    return grouped(spark, sf).select("id", "split")


# every seventh order has no customer: each of those is a group of its own
MISSING = f"""{ORDERS}, om AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'AR_MISSING::' || CAST(id AS VARCHAR) ELSE CAST(ar AS VARCHAR) END AS g FROM oi),
ms AS (SELECT g, count(*) AS size FROM om GROUP BY 1),
mu AS (SELECT g, size, sum(size) OVER (ORDER BY {u_sql(42, 'g')}, g) AS cum, sum(size) OVER () AS total FROM ms),
mp AS (SELECT g, CASE WHEN (cum - size / 2.0) / total < 70.0 / 100 THEN 'train' WHEN (cum - size / 2.0) / total < 85.0 / 100 THEN 'cv' ELSE 'test' END AS split FROM mu)"""


@query("j09_missing_group", f"WITH {MISSING} SELECT om.id, mp.split FROM om JOIN mp USING (g)")
def _(spark, sf):
    o = orders_items(spark, sf).drop("split").withColumn("ar", F.when(F.col("id") % 7 != 0, F.col("ar")))
    return S.group_split(o, "ar", {"train": 70, "cv": 15, "test": 15}, 42, item="id").select("id", "split")


@query("o02_top_movers", f"""WITH {GROUPED}, a AS (SELECT DISTINCT split, ar FROM oi), b AS (SELECT DISTINCT split, ar FROM ni),
m AS (SELECT x.split, x.ar, x.direction, gs.size FROM (SELECT split, ar, 'in' AS direction FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
  UNION ALL SELECT split, ar, 'out' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) x JOIN gs ON gs.ar = x.ar)
SELECT * FROM (SELECT split, ar, direction, size, row_number() OVER (PARTITION BY split, direction ORDER BY size DESC, ar) AS place FROM m) WHERE place <= 20""")
def _(spark, sf):
    return S.top_movers(orders_items(spark, sf), grouped(spark, sf), "ar", 20).select(
        "split", "ar", "direction", "size", F.col("place").cast("long").alias("place"))


@query("j11_removed_rows", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    kept = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return R.anti_rows(o, kept, "id")


@query("j13_label_run_grid", f"""WITH {ORDERS}, c AS (SELECT label, ar, count(*) AS n FROM oi GROUP BY 1, 2)
SELECT l.label, r.ar, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT label FROM oi) l, (SELECT DISTINCT ar FROM oi) r LEFT JOIN c ON c.label = l.label AND c.ar = r.ar""")
def _(spark, sf):
    from flareframe.functions.labels import LABELS
    c = R.class_counts(orders_items(spark, sf), "label", ["ar"])
    full = c.select("ar").distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x in LABELS])))
    return full.join(c, ["ar", "label"], "left").select("label", "ar", F.coalesce("n", F.lit(0)).alias("n"))


@query("o01_output_order", f"WITH {ITEMS} SELECT id, ar, label FROM items ORDER BY ts, id, filepath")
def _(spark, sf):
    return R.output_order(items(spark, sf), "ts", "id", "filepath").select("id", "ar", "label")


@query("o02_top_groups", f"WITH {ORDERS} SELECT ar, count(*) AS n FROM oi GROUP BY 1 ORDER BY n DESC, ar LIMIT 20")
def _(spark, sf):
    return R.top_groups(orders_items(spark, sf), "ar", 20)


@query("o03_worst_violations", f"WITH {ORDERS} SELECT ar, count(DISTINCT split) AS n_splits FROM oi GROUP BY 1 HAVING n_splits > 1 ORDER BY n_splits DESC, ar LIMIT 50")
def _(spark, sf):
    return S.worst_violations(orders_items(spark, sf), "ar").select(
        "ar", F.col("n_splits").cast("long").alias("n_splits"))


@query("o04_first_argmax", f"""WITH {ITEMS}, d AS (SELECT ar, CAST(floor(value / 20) AS BIGINT) AS score, id FROM items),
r AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS k FROM d) SELECT ar, id, score FROM r WHERE k = 1""")
def _(spark, sf):
    from flareframe.operators.curves import argmax_row
    d = items(spark, sf).select("ar", "id", F.floor(F.col("value") / 20).cast("double").alias("score"))
    return argmax_row(d, "score", "id", ["ar"]).select("ar", "id", F.col("score").cast("long").alias("score"))


@query("o05_ordered_counts", f"WITH {ORDERS} SELECT label, count(*) AS n FROM oi GROUP BY 1 ORDER BY n DESC, label")
def _(spark, sf):
    return R.ordered_counts(orders_items(spark, sf), "label")


@query("u01_union_splits", f"WITH {ORDERS} SELECT id, split, CASE WHEN split = 'train' THEN label END AS label FROM oi")
def _(spark, sf):
    o = orders_items(spark, sf)
    part = {s: o.where(F.col("split") == s).drop("split") for s in S.SPLITS}
    part["cv"], part["test"] = part["cv"].drop("label"), part["test"].drop("label")
    return S.union_splits(**part).select("id", "split", "label")


@query("u02_shared_groups", f"""WITH {ORDERS}, p AS (SELECT DISTINCT split, ar FROM oi)
SELECT a.split AS split_a, b.split AS split_b, ar FROM p a JOIN p b USING (ar) WHERE (a.split, b.split) IN (('train', 'cv'), ('train', 'test'), ('cv', 'test'))""")
def _(spark, sf):
    return S.overlap(orders_items(spark, sf), "ar")


@query("u03_moved_groups", f"""WITH {GROUPED}, a AS (SELECT DISTINCT split, ar FROM oi), b AS (SELECT DISTINCT split, ar FROM ni)
SELECT x.split, x.ar, x.direction, gs.size FROM (SELECT split, ar, 'in' AS direction FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
  UNION ALL SELECT split, ar, 'out' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) x JOIN gs ON gs.ar = x.ar""")
def _(spark, sf):
    return S.group_movement(orders_items(spark, sf), grouped(spark, sf), "ar") \
        .select("split", "ar", "direction", "size")


@query("u04_label_domain", f"WITH {ORDERS} SELECT DISTINCT label FROM oi UNION SELECT DISTINCT event_type FROM events")
def _(spark, sf):
    a = orders_items(spark, sf).select("label")
    return a.union(table(spark, sf, "events").select("event_type")).distinct()


