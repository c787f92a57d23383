"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from flareframe.operators import reports as R
from flareframe.operators import splits as S
from flareframe.queries.inputs import GROUPED, ORDERS, orders_items, r6
from flareframe.queries.registry import query
from flareframe.queries.sampling import KEEP, kept
from flareframe.queries.sequences import CLIPS, T, clips
from flareframe.queries.sets import grouped


def _comp(name, expr, collapsed):
    sql = f"""WITH {GROUPED}, a AS (SELECT split, {expr} AS label, count(*) AS n FROM oi GROUP BY 1, 2), b AS (SELECT split, {expr} AS label, count(*) AS n FROM ni GROUP BY 1, 2),
fa AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY split) AS f FROM a), fb AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY split) AS f FROM b)
SELECT coalesce(fa.split, fb.split) AS split, coalesce(fa.label, fb.label) AS label, coalesce(fa.n, 0) AS orig_n, round(coalesce(fa.f, 0), 6) AS orig_frac, coalesce(fb.n, 0) AS new_n,
  round(coalesce(fb.f, 0), 6) AS new_frac, coalesce(fb.n, 0) - coalesce(fa.n, 0) AS d_n, round(coalesce(fb.f, 0) - coalesce(fa.f, 0), 6) + 0.0 AS d_frac FROM fa FULL JOIN fb ON fa.split = fb.split AND fa.label = fb.label"""

    @query(name, sql)
    def _(spark, sf):
        d = S.compare_composition(orders_items(spark, sf), grouped(spark, sf), "label", collapsed)
        return d.withColumns({c: r6(c) for c in ("orig_frac", "new_frac", "d_frac")})


_comp("q01_composition", "label", False)
_comp("q01_collapsed", "CASE label WHEN 'NONE' THEN 'NONE' WHEN 'C' THEN 'OTHER' ELSE 'M+' END", True)


@query("q02_movement", f"""WITH {GROUPED}, a AS (SELECT DISTINCT split, ar FROM oi), b AS (SELECT DISTINCT split, ar FROM ni),
i AS (SELECT x.split, count(*) AS g, sum(size)::BIGINT AS s FROM (SELECT * FROM b EXCEPT SELECT * FROM a) x JOIN gs USING (ar) GROUP BY 1),
o AS (SELECT x.split, count(*) AS g, sum(size)::BIGINT AS s FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x JOIN gs USING (ar) GROUP BY 1),
ca AS (SELECT split, count(DISTINCT ar) AS g, count(*) AS n FROM oi GROUP BY 1), cb AS (SELECT split, count(DISTINCT ar) AS g, count(*) AS n FROM ni GROUP BY 1)
SELECT ca.split, ca.g AS groups_orig, ca.n AS items_orig, cb.g AS groups_new, cb.n AS items_new, coalesce(i.g, 0) AS groups_in, coalesce(o.g, 0) AS groups_out, coalesce(i.s, 0) AS items_in, coalesce(o.s, 0) AS items_out,
  cb.n - ca.n = coalesce(i.s, 0) - coalesce(o.s, 0) AS check_ok FROM ca JOIN cb USING (split) LEFT JOIN i USING (split) LEFT JOIN o USING (split)""")
def _(spark, sf):
    return S.movement_summary(orders_items(spark, sf), grouped(spark, sf), "ar")


@query("q03_exclusivity", f"""WITH {ORDERS}, p AS (SELECT ar, count(DISTINCT split) AS k, count(*) AS n FROM oi GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_items, count(*) AS n_groups, count(CASE WHEN k > 1 THEN 1 END) AS n_violations FROM p""")
def _(spark, sf):
    return S.exclusivity(orders_items(spark, sf), "ar")


@query("q04_overlap_counts", f"""WITH {ORDERS}, p AS (SELECT DISTINCT split, ar FROM oi)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS n FROM p a JOIN p b USING (ar) WHERE (a.split, b.split) IN (('train', 'cv'), ('train', 'test'), ('cv', 'test')) GROUP BY 1, 2""")
def _(spark, sf):
    return S.overlap(orders_items(spark, sf), "ar").groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("n"))


@query("q05_split_sizes", f"""WITH {GROUPED}, a AS (SELECT split, count(*) AS n FROM oi GROUP BY 1), b AS (SELECT split, count(*) AS n FROM ni GROUP BY 1)
SELECT a.split, a.n AS original, b.n AS achieved, CAST(CASE a.split WHEN 'train' THEN 1000 WHEN 'cv' THEN 200 ELSE 300 END AS BIGINT) AS target,
  b.n - CASE a.split WHEN 'train' THEN 1000 WHEN 'cv' THEN 200 ELSE 300 END AS diff FROM a JOIN b USING (split)""")
def _(spark, sf):
    return S.split_sizes_report(orders_items(spark, sf), grouped(spark, sf), {"train": 1000, "cv": 200, "test": 300})


@query("q06_clip_integrity", f"""WITH {CLIPS} SELECT ar, count(*) AS n, count(CASE WHEN ar % 3 = 0 THEN 1 END) AS n_ok,
  CASE ar % 3 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE '0,1' END AS bad FROM clips GROUP BY ar""")
def _(spark, sf):
    from flareframe.operators.sequences import clip_integrity
    f = [F.get("filepaths", F.lit(i)) for i in range(3)]
    # a third of the entities keep their frames; the others repeat one, so one gap or both are wrong
    frames = F.when(F.col("ar") % 3 == 0, F.col("filepaths")).when(F.col("ar") % 3 == 1, F.array(f[0], f[0], f[1])).otherwise(F.array(f[0], f[2], f[2]))
    d = clip_integrity(clips(spark, sf).withColumn("filepaths", frames), "filepaths", "2 hours")
    return d.groupBy("ar").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), F.max(F.array_join("bad_positions", ",")).alias("bad"))


@query("q07_clip_distribution", f"""WITH {CLIPS}, c AS (SELECT label, ar, count(*) AS n FROM clips GROUP BY 1, 2)
SELECT label, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, min(n) AS n_min, max(n) AS n_max, round(avg(n), 6) AS n_mean FROM c GROUP BY 1""")
def _(spark, sf):
    return R.distribution(clips(spark, sf), "ar", ["label"]).withColumn("n_mean", r6("n_mean"))


@query("q08_downsample_report", f"""WITH {KEEP}, b AS (SELECT label, ar, count(*) AS nb, count(CASE WHEN keep THEN 1 END) AS na FROM kp GROUP BY 1, 2)
SELECT label, CAST(sum(nb) AS BIGINT) AS n_before, CAST(sum(na) AS BIGINT) AS n_after, count(*) AS groups_before, count(CASE WHEN na > 0 THEN 1 END) AS groups_after, count(CASE WHEN na = 0 THEN 1 END) AS groups_lost FROM b GROUP BY 1""")
def _(spark, sf):
    from flareframe.operators.sampling import before_after
    return before_after(kept(spark, sf), "label", "ar").groupBy("label").agg(
        F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"),
        F.count(F.lit(1)).alias("groups_before"), F.count_if(~F.col("lost")).alias("groups_after"),
        F.count_if("lost").alias("groups_lost"))


LEN = CLIPS + """, le AS (SELECT ar, t_start, CASE WHEN hour(t_start) % 6 = 0 THEN 4 ELSE 3 END AS want FROM clips)"""


def checked(spark, sf):
    shorter = F.when(F.hour("t_start") % 6 == 0, F.lit(4)).otherwise(3)
    from flareframe.operators.grid import from_micros
    from flareframe.operators.ordered import micros
    d = clips(spark, sf).withColumn("e", from_micros(micros("t_start") + shorter.cast("long") * 3_600_000_000))
    return R.length_error(d, "filepaths", "t_start", "e", "1 hour")


@query("q09_length_errors", f"WITH {LEN} SELECT ar, strftime(t_start, {T}) AS t, CASE WHEN want <> 3 THEN 'length 3 expected ' || want END AS error FROM le")
def _(spark, sf):
    return checked(spark, sf).select("ar", F.date_format("t_start", "yyyy-MM-dd HH:mm:ss").alias("t"), "error")


@query("f10_only_matched", f"WITH {LEN} SELECT ar, count(*) AS n FROM le WHERE want = 3 GROUP BY 1")
def _(spark, sf):
    return R.only_matched(checked(spark, sf), "error").groupBy("ar").agg(F.count(F.lit(1)).alias("n"))
