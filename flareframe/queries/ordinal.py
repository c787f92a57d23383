"""Multilabel and ordinal forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from flareframe.functions import decode as D
from flareframe.operators import curves as C
from flareframe.operators import expected as X
from flareframe.operators import metrics as M
from flareframe.operators import multilabel as L
from flareframe.queries.decoding import FREE
from flareframe.queries.inputs import LOGITS, ORD, SCORES, logits, r6, scores
from flareframe.queries.metrics import FLAT, ovr_sql, rnd
from flareframe.queries.registry import query

# three labels per row: truth = bits of the class, forecast = sign of the first three logits
ML = LOGITS + """, ml AS (SELECT id, CAST(j AS BIGINT) AS j, CAST((label >> j) % 2 AS INT) AS t, [x0, x1, x2][j + 1] AS x, CASE WHEN 1 / (1 + exp(-[x0, x1, x2][j + 1])) >= 0.5 THEN 1 ELSE 0 END AS f
  FROM lg, (SELECT unnest([0, 1, 2]) AS j) k)"""


def multi(spark, sf):
    return logits(spark, sf).select("id", "bits", "ologits").withColumn(
        "flags", D.multilabel_flags(F.col("ologits")))


HS = ML + """, hs AS (SELECT id, sum(t * f) AS i, sum(greatest(t, f)) AS u, min(CASE WHEN t = f THEN 1 ELSE 0 END) AS same FROM ml GROUP BY 1)"""


@query("m23_hamming_score", f"WITH {HS} SELECT round(avg(CASE WHEN u = 0 THEN 1 ELSE i / u::DOUBLE END), 6) AS v2, round(avg(i / nullif(u, 0)::DOUBLE), 6) AS v1 FROM hs")
def _(spark, sf):
    d = multi(spark, sf)
    v2 = L.hamming_score(d, "bits", "flags").select(r6("hamming_score").alias("v2"))
    return v2.withColumn("v1", L.hamming_score(d, "bits", "flags", False).select(r6("hamming_score")).scalar())


@query("m24_multilabel_metrics", f"""WITH {HS}, lc AS (SELECT j, sum(t * f)::DOUBLE AS tp, sum((1 - t) * f)::DOUBLE AS fp, sum(t * (1 - f))::DOUBLE AS fn, sum((1 - t) * (1 - f))::DOUBLE AS tn FROM ml GROUP BY 1),
pf AS (SELECT *, tp + fn AS s, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS g FROM lc),
u AS (SELECT 'accuracy' AS metric, avg(same)::DOUBLE AS value FROM hs UNION ALL SELECT 'h_score', avg(CASE WHEN u = 0 THEN 1 ELSE i / u::DOUBLE END) FROM hs
UNION ALL SELECT unnest(['precision', 'recall', 'f1score', 'f1score_micro', 'h_loss', 'roc_auc']), unnest([sum(p * s) / sum(s), sum(r * s) / sum(s), sum(g * s) / sum(s), 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)),
  (sum(fp) + sum(fn)) / sum(tp + fp + fn + tn), (sum(tp) / (sum(tp) + sum(fn)) + sum(tn) / (sum(tn) + sum(fp))) / 2]) FROM pf
UNION ALL SELECT 'accuracy_class_' || j, (tp + tn) / (tp + fp + fn + tn) FROM lc)
SELECT metric, round(value, 6) + 0.0 AS value FROM u""")
def _(spark, sf):
    return rnd(L.multilabel_metrics(multi(spark, sf), "bits", "ologits"), ["value"])


KAPPA = ORD + """, kc AS (SELECT y, (g1 >= 0.5)::INT + (g2 >= 0.5)::INT + (g3 >= 0.5)::INT AS h FROM og), kn AS (SELECT y, h, count(*)::DOUBLE AS n FROM kc GROUP BY 1, 2),
ka AS (SELECT sum(n) AS total, sum(n * (y - h) * (y - h)) AS o FROM kn), ry AS (SELECT y, sum(n) AS r FROM kn GROUP BY 1), ch AS (SELECT h, sum(n) AS c FROM kn GROUP BY 1),
kx AS (SELECT 1 - (SELECT o FROM ka) / (sum(r * c * (y - h) * (y - h)) / (SELECT total FROM ka)) AS qwk FROM ry CROSS JOIN ch)"""


def ordinal(spark, sf):
    return logits(spark, sf).select("id", "y", "ologits")


@query("m25_quadratic_kappa", f"WITH {KAPPA} SELECT round(qwk, 6) + 0.0 AS qwk FROM kx")
def _(spark, sf):
    d = ordinal(spark, sf).withColumn("yord", D.ordinal_class(F.col("ologits")))
    return rnd(M.quadratic_kappa(M.confusion(d, "y", "yord", 4)), ["qwk"])


# boundary tasks [class >= k] ranked by the k-th cumulative probability
BT = ORD + """, bt AS (SELECT CAST(k AS BIGINT) AS threshold, CASE WHEN y >= k THEN 1.0::DOUBLE ELSE 0 END AS t, [g1, g2, g3][k] AS p FROM og, (SELECT unnest([1, 2, 3]) AS k) q),
au AS (SELECT a.threshold, sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auc FROM bt a JOIN bt b ON a.threshold = b.threshold AND a.t = 1 AND b.t = 0 GROUP BY 1),
pr AS (SELECT threshold, t, p, sum(t) OVER w AS ct, count(*) OVER w AS cn FROM bt WINDOW w AS (PARTITION BY threshold ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ap AS (SELECT threshold, sum(t * ct / cn) / sum(t) AS ap FROM pr GROUP BY 1)"""


@query("m26_roc_auc", f"WITH {BT} SELECT threshold, round(auc, 6) AS auc FROM au")
def _(spark, sf):
    b = L.boundary_scores(ordinal(spark, sf), "y", "ologits")
    return b.select(F.col("threshold").cast("long").alias("threshold"), r6("auc").alias("auc"))


@query("m27_average_precision", f"WITH {BT} SELECT threshold, round(ap, 6) AS ap FROM ap")
def _(spark, sf):
    b = L.boundary_scores(ordinal(spark, sf), "y", "ologits")
    return b.select(F.col("threshold").cast("long").alias("threshold"), r6("ap").alias("ap"))


@query("m26_roc_auc_ties", f"""WITH {SCORES}, g AS (SELECT p, sum(y)::DOUBLE AS t, sum(1 - y)::DOUBLE AS f FROM scores GROUP BY 1),
c AS (SELECT t, f, sum(t) OVER (ORDER BY p DESC) AS ct FROM g) SELECT round(sum(f * (ct - t / 2)) / (sum(t) * sum(f)), 6) AS auc FROM c""")
def _(spark, sf):
    return rnd(C.roc_auc(scores(spark, sf), "p", "y"), ["auc"])


@query("m27_average_precision_ties", f"""WITH {SCORES}, g AS (SELECT p, sum(y)::DOUBLE AS t, sum(1 - y)::DOUBLE AS f FROM scores GROUP BY 1),
c AS (SELECT t, sum(t) OVER (ORDER BY p DESC) AS ct, sum(f) OVER (ORDER BY p DESC) AS cf FROM g) SELECT round(sum(t * ct / (ct + cf)) / sum(t), 6) AS ap FROM c""")
def _(spark, sf):
    return rnd(C.average_precision(scores(spark, sf), "p", "y"), ["ap"])


MV = "mv AS (SELECT avg(CASE WHEN g1 < g2 OR g2 < g3 THEN 1.0::DOUBLE ELSE 0 END) AS mvr, (sum(greatest(g2 - g1, 0)) + sum(greatest(g3 - g2, 0))) / (2 * count(*)) AS mvm FROM og)"


@query("m28_monotonicity", f"WITH {ORD}, {MV} SELECT round(mvr, 6) AS mvr, round(mvm, 6) AS mvm FROM mv")
def _(spark, sf):
    return rnd(L.monotonicity(ordinal(spark, sf), "ologits"), ["mvr", "mvm"])


@query("m29_ordinal_metrics", f"""WITH {BT}, {MV}, {KAPPA[len(ORD) + 2:]}, {FREE[len(ORD) + 2:]},
best AS (SELECT y, CASE greatest(p0, p1, p2, p3) WHEN p0 THEN 0 WHEN p1 THEN 1 WHEN p2 THEN 2 ELSE 3 END AS h FROM op),
{ovr_sql('best', 4)}, {FLAT}, u AS (SELECT * FROM flat UNION ALL SELECT 'qwk', qwk FROM kx UNION ALL SELECT 'auc_' || threshold, auc FROM au
UNION ALL SELECT 'ap_' || threshold, ap FROM ap UNION ALL SELECT 'mvr', mvr FROM mv UNION ALL SELECT 'mvm', mvm FROM mv)
SELECT metric, round(value, 6) + 0.0 AS value FROM u""")
def _(spark, sf):
    # truth as cumulative flags: the other accepted form
    d = ordinal(spark, sf).withColumn("y", F.transform(F.sequence(F.lit(1), F.lit(3)),
                                                       lambda k: (F.col("y") >= k).cast("int")))
    return rnd(L.ordinal_metrics(d, "y", "ologits", 4), ["value"])


@query("m32_multilabel_focal", f"""WITH {ML}, l AS (SELECT t, [1.0, 2.0, 0.5][j + 1] AS w, 1 / (1 + exp(-x)) AS p FROM ml),
b AS (SELECT -(w * t * ln(p) + (1 - t) * ln(1 - p)) AS bce, CASE WHEN t = 1 THEN p ELSE 1 - p END AS pt FROM l)
SELECT round(avg(pow(greatest(1 - pt, 1e-8), 2) * bce), 6) AS focal, round(avg(bce), 6) AS bce FROM b""")
def _(spark, sf):
    d = multi(spark, sf)
    f = X.focal_score_multilabel(d, "ologits", "bits", 2.0, [1.0, 2.0, 0.5]).select(r6("loss").alias("focal"))
    b = X.focal_score_multilabel(d, "ologits", "bits", 0.0, [1.0, 2.0, 0.5]).select(r6("loss").alias("bce"))
    return f.withColumn("bce", b.scalar())
