"""Verification of single-label and binary forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from flareframe.functions.labels import LABELS
from flareframe.operators import curves as C
from flareframe.operators import expected as X
from flareframe.operators import metrics as M
from flareframe.queries.decoding import TOP
from flareframe.queries.inputs import CLASSES, LOGITS, LONG, SCORES, classes, logits, r6, scores
from flareframe.queries.registry import query

K3 = "(SELECT unnest([0, 1, 2]) AS {0}) {0}t"
CM = CLASSES + f""", cn AS (SELECT y, yhat, count(*) AS n FROM classes GROUP BY 1, 2),
cm AS (SELECT CAST(yt.y AS BIGINT) AS y, CAST(ht.h AS BIGINT) AS yhat, coalesce(n, 0) AS n FROM {K3.format('y')} CROSS JOIN {K3.format('h')} LEFT JOIN cn ON cn.y = yt.y AND cn.yhat = ht.h),
ov AS (SELECT c.y AS cls, CAST(sum(CASE WHEN m.y = c.y AND m.yhat = c.y THEN n ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN m.y <> c.y AND m.yhat = c.y THEN n ELSE 0 END) AS DOUBLE) AS fp,
  CAST(sum(CASE WHEN m.y = c.y AND m.yhat <> c.y THEN n ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN m.y <> c.y AND m.yhat <> c.y THEN n ELSE 0 END) AS DOUBLE) AS tn
  FROM (SELECT DISTINCT y FROM cm) c CROSS JOIN cm m GROUP BY 1)"""


def rates_sql(src, eps="1e-12"):
    return f"""rt AS (SELECT *, tp + fn AS support, tp / (tp + fn + {eps}) AS tpr, tn / (tn + fp + {eps}) AS tnr, tp / nullif(tp + fp, 0) AS ppv, tn / nullif(tn + fn, 0) AS npv,
  fp / nullif(fp + tn, 0) AS fpr, fn / nullif(tp + fn, 0) AS fnr, fp / nullif(tp + fp, 0) AS fdr, (tp + tn) / (tp + fp + fn + tn) AS acc FROM {src}),
sk AS (SELECT *, tpr + tnr - 1 AS tss, 2 * (tp * tn - fp * fn) / nullif((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn), 0) AS hss,
  (tp - (tp + fn) * (tp + fp) / (tp + fp + fn + tn)) / nullif(tp + fp + fn - (tp + fn) * (tp + fp) / (tp + fp + fn + tn), 0) AS gss,
  (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) + 1e-12) AS mcc,
  ((tp + tn) / (tp + fp + fn + tn) - greatest(tp + fn, fp + tn) / (tp + fp + fn + tn)) / greatest(1 - greatest(tp + fn, fp + tn) / (tp + fp + fn + tn), 1e-12) AS apss FROM rt)"""


def cm3(spark, sf):
    return M.confusion(classes(spark, sf), "y", "yhat", 3)


def rnd(df, cols, digits=6):
    return df.withColumns({c: r6(c, digits) for c in cols})


@query("a19_confusion", f"WITH {CM} SELECT y, yhat, n, round(coalesce(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY y), 0), 0), 6) AS share FROM cm")
def _(spark, sf):
    return rnd(cm3(spark, sf), ["share"])


@query("a20_one_vs_rest", f"WITH {CM} SELECT cls, tp, fp, fn, tn, tp + fn AS support FROM ov")
def _(spark, sf):
    return M.one_vs_rest(cm3(spark, sf))


@query("m01_accuracy", f"WITH {CLASSES} SELECT round(avg(CASE WHEN y = yhat THEN 1.0 ELSE 0 END), 6) AS accuracy FROM classes")
def _(spark, sf):
    return rnd(M.accuracy(classes(spark, sf), "y", "yhat"), ["accuracy"])


PRF = CM + """, pf AS (SELECT cls, tp, fp, fn, tp + fn AS s, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM ov)"""


@query("m02_weighted_prf", f"WITH {PRF} SELECT round(sum(p * s) / sum(s), 6) AS precision, round(sum(r * s) / sum(s), 6) AS recall, round(sum(f * s) / sum(s), 6) AS f1_weighted FROM pf")
def _(spark, sf):
    d = M.weighted_f1(cm3(spark, sf)).select("precision", "recall", "f1_weighted")
    return rnd(d, d.columns)


@query("m03_micro_macro_f1", f"WITH {PRF} SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1_micro, round(avg(f), 6) AS f1_macro FROM pf")
def _(spark, sf):
    d = M.weighted_f1(cm3(spark, sf)).select("f1_micro", "f1_macro")
    return rnd(d, d.columns)


@query("m04_classification_report", f"""WITH {PRF}, x AS (SELECT CASE cls WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS name, p, r, f, s FROM pf
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM pf UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM pf)
SELECT name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM x""")
def _(spark, sf):
    return rnd(M.classification_report(cm3(spark, sf), ["low", "mid", "high"]), ["precision", "recall", "f1"])


def _scores(name, cols):
    sel = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)

    @query(name, f"WITH {CM}, {rates_sql('ov')} SELECT cls, {sel} FROM sk")
    def _(spark, sf):
        d = M.skill_scores(M.one_vs_rest(cm3(spark, sf))).select("cls", *cols)
        return rnd(d, cols)


_scores("m05_rates", ["tpr", "tnr", "ppv", "npv", "fpr", "fnr", "fdr", "acc"])
_scores("m06_tss", ["tss"])
_scores("m07_hss", ["hss"])
_scores("m08_gss", ["gss"])
_scores("m09_mcc", ["mcc"])
_scores("m12_appleman", ["apss"])


@query("m09_multiclass_mcc", f"""WITH {CM}, o AS (SELECT sum(tp) AS c, sum(tp + fn) AS s, sum((tp + fp) * (tp + fn)) AS pt, sum((tp + fp) * (tp + fp)) AS pp, sum((tp + fn) * (tp + fn)) AS tt FROM ov)
SELECT round((c * s - pt) / sqrt((s * s - pp) * (s * s - tt)), 6) + 0.0 AS mcc FROM o""")
def _(spark, sf):
    return rnd(M.multiclass_mcc(cm3(spark, sf)), ["mcc"])


@query("m10_class_summary", f"""WITH {CM}, {rates_sql('ov')}, v AS (SELECT cls, support, unnest(['tss', 'hss', 'gss']) AS score, unnest([tss, hss, gss]) AS x FROM sk)
SELECT score, round(avg(x), 6) + 0.0 AS macro, round(sum(x * support) / ((SELECT sum(support) FROM sk) + 1e-7), 6) + 0.0 AS weighted FROM v GROUP BY 1""")
def _(spark, sf):
    s = M.class_summary(M.skill_scores(M.one_vs_rest(cm3(spark, sf))), ["tss", "hss", "gss"])
    return rnd(s, ["macro", "weighted"])


MICRO = CM + """, mt AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM ov),
mi AS (SELECT *, tp + fp + fn + tn AS n, tp / (tp + fn + 1e-7) AS tpr, tn / (tn + fp + 1e-7) AS tnr, tp / (tp + fp + 1e-7) AS ppv, tn / (tn + fn + 1e-7) AS npv,
  fp / (fp + tn + 1e-7) AS fpr, fn / (tp + fn + 1e-7) AS fnr, fp / (tp + fp + 1e-7) AS fdr, (tp + fn) * (tp + fp) / (tp + fp + fn + tn + 1e-7) AS ch FROM mt)"""


@query("m11_micro_scores", f"""WITH {MICRO} SELECT tp, fp, fn, tn, n, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr, round(ppv, 6) AS ppv, round(npv, 6) AS npv, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr,
  round(fdr, 6) AS fdr, round(tpr + tnr - 1, 6) + 0.0 AS tss, round(2 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn) + 1e-7), 6) + 0.0 AS hss,
  round((tp - ch) / (tp + fp + fn - ch + 1e-7), 6) + 0.0 AS gss, round((tp + tn) / (n + 1e-7), 6) AS accuracy FROM mi""")
def _(spark, sf):
    d = M.micro_scores(cm3(spark, sf))
    return rnd(d, [c for c in d.columns if c not in ("tp", "fp", "fn", "tn", "n")])


@query("m13_brier_skill", f"""WITH {SCORES}, m AS (SELECT avg((p - y) * (p - y)) AS mse, avg(y) AS o FROM scores) SELECT round(1 - mse / (o * (1 - o)), 6) AS bss FROM m""")
def _(spark, sf):
    return rnd(M.brier_skill(scores(spark, sf), "p", "y"), ["bss"])


def cm2(spark, sf):
    d = scores(spark, sf).withColumn("yhat", (F.col("p") >= 0.4).cast("int"))
    return M.confusion(d, "y", "yhat", 2)


B2 = SCORES + """, b AS (SELECT count(CASE WHEN y = 1 AND p >= 0.4 THEN 1 END)::DOUBLE AS tp, count(CASE WHEN y = 0 AND p >= 0.4 THEN 1 END)::DOUBLE AS fp,
  count(CASE WHEN y = 1 AND p < 0.4 THEN 1 END)::DOUBLE AS fn, count(CASE WHEN y = 0 AND p < 0.4 THEN 1 END)::DOUBLE AS tn FROM scores)"""


@query("a20_binary_counts", f"WITH {B2} SELECT tp, fp, fn, tn FROM b")
def _(spark, sf):
    return M.binary_counts(cm2(spark, sf)).select("tp", "fp", "fn", "tn")


@query("m14_binary_class_scores", f"""WITH {B2}, v AS (SELECT *, tp / (tp + fp + 1e-12) AS pp, tp / (tp + fn + 1e-12) AS rp, tn / (tn + fn + 1e-12) AS pn, tn / (tn + fp + 1e-12) AS rn FROM b)
SELECT round(2 * pp * rp / (pp + rp + 1e-12), 6) AS f1_pos, round(2 * pn * rn / (pn + rn + 1e-12), 6) AS f1_neg, round(rp + rn - 1, 6) + 0.0 AS tss_pos, round(rp + rn - 1, 6) + 0.0 AS tss_neg FROM v""")
def _(spark, sf):
    d = M.binary_class_scores(M.binary_counts(cm2(spark, sf)))
    return rnd(d, d.columns)


def tick_sql(ticks, by=""):
    b = f"{by}, " if by else ""
    on = f"s.{by} = r.{by} AND " if by else ""
    runs = f"(SELECT DISTINCT {by} FROM scores) r, " if by else ""
    return f"""tk AS (SELECT CAST(i AS BIGINT) AS tick, CASE WHEN i = {ticks - 1} THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / {ticks - 1}) END AS threshold FROM (SELECT unnest(generate_series(0, {ticks - 1})) AS i) q),
pv AS (SELECT {b}p, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM scores GROUP BY ALL),
tc AS (SELECT {('r.' + by + ', ') if by else ''}tick, threshold, sum(CASE WHEN p >= threshold THEN a ELSE 0 END) AS tp, sum(CASE WHEN p >= threshold THEN b ELSE 0 END) AS fp,
  sum(CASE WHEN p >= threshold THEN 0 ELSE a END) AS fn, sum(CASE WHEN p >= threshold THEN 0 ELSE b END) AS tn FROM {runs}tk JOIN pv s ON {on if by else ''}true GROUP BY ALL)"""


def curve_sql(ticks, by=""):
    sql = tick_sql(ticks, by)
    if by:
        sql = sql.replace(f"FROM (SELECT DISTINCT {by} FROM scores) r, tk JOIN pv s ON s.{by} = r.{by} AND true",
                          f"FROM (SELECT DISTINCT {by} FROM scores) r CROSS JOIN tk JOIN pv s ON s.{by} = r.{by}")
    return sql + f""", c0 AS (SELECT *, tp / (tp + fp + 1e-12) AS precision, tp / (tp + fn + 1e-12) AS recall, tn / (tn + fp + 1e-12) AS tnr, greatest(tp + fn, fp + tn) / (tp + fp + fn + tn) AS base FROM tc),
cv AS (SELECT {by + ', ' if by else ''}tick, threshold, tp, fp, fn, tn, precision, recall, 2 * (precision * recall / (precision + recall + 1e-12)) AS f1, recall + tnr - 1 AS tss,
  2 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn) + 1e-12) AS hss, (tp * tn - fp * fn) / (sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) + 1e-12)) AS mcc,
  ((tp + tn) / (tp + fp + fn + tn) - base) / greatest(1 - base, 1e-12) AS apss FROM c0)"""


@query("w10_tick_counts", f"WITH {SCORES}, {tick_sql(1001)} SELECT tick, round(threshold, 6) AS threshold, tp, fp, fn, tn FROM tc")
def _(spark, sf):
    return rnd(C.tick_counts(scores(spark, sf), "p", "y"), ["threshold"])


CURVE = SCORES + ", " + curve_sql(1001)
CROUND = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in C.CURVE)


def curve(spark, sf):
    return C.threshold_curves(scores(spark, sf), "p", "y")


@query("m15_threshold_curves", f"WITH {CURVE} SELECT tick, round(threshold, 6) AS threshold, {CROUND} FROM cv")
def _(spark, sf):
    return rnd(curve(spark, sf).select("tick", "threshold", *C.CURVE), ["threshold", *C.CURVE])


@query("m16_best_thresholds", f"""WITH {CURVE}, x AS (SELECT 'tss' AS criterion, tick, tp, fp, fn, tn, row_number() OVER (ORDER BY tss DESC, tick) AS k FROM cv
  UNION ALL SELECT 'f1', tick, tp, fp, fn, tn, row_number() OVER (ORDER BY f1 DESC, tick) FROM cv UNION ALL SELECT 'mcc', tick, tp, fp, fn, tn, row_number() OVER (ORDER BY mcc DESC, tick) FROM cv)
SELECT criterion, tick, tp, fp, fn, tn FROM x WHERE k = 1""")
def _(spark, sf):
    b = C.best_thresholds(curve(spark, sf)).where("criterion <> 'precrec'")
    return b.select("criterion", "tick", "tp", "fp", "fn", "tn")


@query("m17_crossing", f"""WITH {CURVE}, x AS (SELECT tick, threshold, precision, recall, row_number() OVER (ORDER BY abs(precision - recall), tick) AS k FROM cv WHERE precision > 0 AND recall > 0)
SELECT tick, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM x WHERE k = 1""")
def _(spark, sf):
    c = C.crossing(curve(spark, sf)).select("tick", "threshold", "precision", "recall")
    return rnd(c, ["threshold", "precision", "recall"])


@query("m18_threshold_for", f"""WITH {CURVE} SELECT 'precision' AS target, round(max(CASE WHEN precision >= 0.2 AND recall >= 0.3 THEN threshold END), 6) AS threshold FROM cv
  UNION ALL SELECT 'recall', round(min(CASE WHEN recall >= 0.5 THEN threshold END), 6) FROM cv UNION ALL SELECT 'impossible', max(CASE WHEN precision >= 2 THEN threshold END) FROM cv""")
def _(spark, sf):
    c = curve(spark, sf)
    parts = [C.threshold_for(c, 0.2, 0.3).withColumn("target", F.lit("precision")),
             C.threshold_for(c, recall=0.5, highest=False).withColumn("target", F.lit("recall")),
             C.threshold_for(c, 2.0).withColumn("target", F.lit("impossible"))]
    return rnd(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["threshold"])


@query("m19_best_tss", f"""WITH {SCORES}, {tick_sql(101)}, v AS (SELECT tick, threshold, tp / (tp + fn + 1e-7) AS tpr, tn / (tn + fp + 1e-7) AS tnr FROM tc), x AS (SELECT *, row_number() OVER (ORDER BY tpr + tnr - 1.0 DESC, tick) AS k FROM v)
SELECT round(tpr + tnr - 1, 6) AS tss, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr FROM x WHERE k = 1""")
def _(spark, sf):
    d = C.best_tss(scores(spark, sf), "p", "y")
    return rnd(d, d.columns)


# per-run curves on 21 knots, brought to a common grid of 101 ticks
RUNC = SCORES + ", " + curve_sql(21, "run")


def run_curves(spark, sf):
    return C.threshold_curves(scores(spark, sf), "p", "y", 21, by=["run"])


INTERP = RUNC + """, g AS (SELECT run, CAST(i AS BIGINT) AS tick, CASE WHEN i = 100 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 100) END AS x FROM (SELECT unnest(generate_series(0, 100)) AS i) q CROSS JOIN (SELECT DISTINCT run FROM cv) r),
gi AS (SELECT g.run, g.tick, g.x, max(CASE WHEN threshold <= g.x THEN cv.tick END) AS k0, min(CASE WHEN threshold > g.x THEN cv.tick END) AS k1 FROM g JOIN cv ON cv.run = g.run GROUP BY 1, 2, 3),
gv AS (SELECT gi.run, gi.tick, gi.x AS threshold, """ + ", ".join(
    f"CASE WHEN b.tick IS NULL THEN a.{c} ELSE (b.{c} - a.{c}) / (b.threshold - a.threshold) * (gi.x - a.threshold) + a.{c} END AS {c}" for c in C.CURVE) + """
  FROM gi JOIN cv a ON a.run = gi.run AND a.tick = gi.k0 LEFT JOIN cv b ON b.run = gi.run AND b.tick = gi.k1)"""


@query("j10_interp_to_grid", f"WITH {INTERP} SELECT run, tick, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(tss, 6) + 0.0 AS tss FROM gv")
def _(spark, sf):
    g = C.interp_to_grid(run_curves(spark, sf), "run", "threshold", C.CURVE, 101)
    return rnd(g.select("run", "tick", "precision", "recall", "tss"), ["precision", "recall", "tss"])


def _consensus(name, recall, precision, penalty):
    ok = " AND ".join(["true"] + ([f"mr >= {recall}"] if recall else []) + ([f"mp >= {precision}"] if precision else []))
    sql = f"""WITH {INTERP}, m AS (SELECT tick, threshold, avg(tss) AS mt, stddev_samp(tss) AS st, avg(recall) AS mr, avg(precision) AS mp, avg(f1) AS mf FROM gv GROUP BY 1, 2),
o AS (SELECT *, {ok} AS ok FROM m), x AS (SELECT *, row_number() OVER (ORDER BY mt - {penalty} * st DESC, tick) AS k FROM o WHERE ok OR NOT (SELECT bool_or(ok) FROM o))
SELECT round(threshold, 6) AS tau, round(mt, 6) + 0.0 AS mean_tss, round(st, 6) AS std_tss, round(mr, 6) AS mean_recall, round(mp, 6) AS mean_precision, round(mf, 6) AS mean_f1 FROM x WHERE k = 1"""

    @query(name, sql)
    def _(spark, sf):
        d = C.consensus_threshold(run_curves(spark, sf), "run", recall, precision, penalty, ticks=101)
        return rnd(d.select("tau", "mean_tss", "std_tss", "mean_recall", "mean_precision", "mean_f1"),
                   ["tau", "mean_tss", "std_tss", "mean_recall", "mean_precision", "mean_f1"])


@query("m30_consensus_weighted", f"""WITH {INTERP}, m AS (SELECT tick, threshold, sum(tss * (run + 1)) / sum(run + 1) AS mt, stddev_samp(tss) AS st, sum(recall * (run + 1)) / sum(run + 1) AS mr FROM gv GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER (ORDER BY mt - 0.1 * st DESC, tick) AS k FROM m)
SELECT round(threshold, 6) AS tau, round(mt, 6) + 0.0 AS mean_tss, round(st, 6) AS std_tss, round(mr, 6) AS mean_recall FROM x WHERE k = 1""")
def _(spark, sf):
    curves = run_curves(spark, sf)
    w = curves.select("run").distinct().withColumn("weight", F.col("run") + 1)
    d = C.consensus_threshold(curves, "run", penalty=0.1, weights=w, ticks=101)
    return rnd(d.select("tau", "mean_tss", "std_tss", "mean_recall"), ["tau", "mean_tss", "std_tss", "mean_recall"])


_consensus("m30_consensus_threshold", 0.3, None, 0.05)
_consensus("m30_consensus_relaxed", 2.0, 0.1, 0.0)

# expected confusion over class probabilities
EXPECT = LONG + """, ex AS (SELECT j AS cls, sum(CASE WHEN y = j THEN {f} ELSE 0 END) AS tp, sum(CASE WHEN y = j THEN 0 ELSE {f} END) AS fp,
  sum(CASE WHEN y = j THEN 1 - {f} ELSE 0 END) AS fn, sum(CASE WHEN y = j THEN 0 ELSE 1 - {f} END) AS tn, greatest(sum(CASE WHEN y = j THEN 0.0 ELSE 1 END), 1) AS neg FROM soft GROUP BY 1)"""


def soft(spark, sf):
    from flareframe.functions.decode import softmax
    return logits(spark, sf).withColumn("probs", softmax(F.col("logits")))


@query("m20_expected_confusion", f"WITH {EXPECT.format(f='p')} SELECT CAST(cls AS BIGINT) AS cls, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, round(tn, 6) AS tn FROM ex")
def _(spark, sf):
    d = X.expected_confusion(soft(spark, sf), "probs", "y").select(F.col("cls").cast("long").alias("cls"), "tp", "fp", "fn", "tn")
    return rnd(d, ["tp", "fp", "fn", "tn"])


COS = "CASE WHEN p > 0.3 + 0.2 THEN 1 WHEN p < 0.3 - 0.2 THEN 0 ELSE 0.5 * (1 + (p - 0.3) / 0.2 + sin(pi() * (p - 0.3) / 0.2) / pi()) END"
FORM = {"accuracy": "(tp + tn) / (tp + fp + fn + tn)", "precision": "tp / (tp + fp)", "recall": "tp / (tp + fn)", "specificity": "tn / (tn + fp)",
        "f1": "2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))", "tss": "tp / (tp + fn) + tn / (tn + fp) - 1",
        "csi": "tp / (tp + fp + fn)", "hss1": "(tp - fp) / (tp + fn)", "hss2": "2 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (tn + fp))"}


def _expected(prior, f):
    sel = " UNION ALL ".join(f"SELECT '{s}' AS score_name, round(avg({e}), 6) + 0.0 AS average, round(sum(({e}) * neg) / sum(neg), 6) + 0.0 AS weighted FROM ex" for s, e in FORM.items())

    @query(f"m21_expected_scores_{prior}", f"WITH {EXPECT.format(f='(' + f + ')')} {sel}")
    def _(spark, sf):
        c = X.expected_confusion(soft(spark, sf), "probs", "y", prior=prior, mu=0.3, delta=0.2)
        aggs = [F.struct(F.lit(s).alias("score_name"), F.avg(X.score_of(s)).alias("average"),
                         (F.sum(X.score_of(s) * F.col("negatives")) / F.sum("negatives")).alias("weighted")).alias(s)
                for s in X.SCORES]
        d = c.agg(*aggs).select(F.explode(F.array(*X.SCORES)).alias("x")).select("x.*")
        return rnd(d, ["average", "weighted"])


_expected("uniform", "p")
_expected("cosine", COS)


@query("m20_expected_tss", f"WITH {EXPECT.format(f='p')} SELECT round(avg(tp / (tp + fn) + tn / (tn + fp) - 1), 6) + 0.0 AS score, round(1 - avg(tp / (tp + fn) + tn / (tn + fp) - 1), 6) AS loss FROM ex")
def _(spark, sf):
    return rnd(X.expected_score(soft(spark, sf), "probs", "y", add_constant=True), ["score", "loss"])


@query("m22_chunked_loss", f"""WITH {LONG}, rk AS (SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 64) AS BIGINT) AS chunk FROM lg),
ex AS (SELECT chunk, j, sum(CASE WHEN y = j THEN p ELSE 0 END) AS tp, sum(CASE WHEN y = j THEN 0 ELSE p END) AS fp, sum(CASE WHEN y = j THEN 1 - p ELSE 0 END) AS fn, sum(CASE WHEN y = j THEN 0 ELSE 1 - p END) AS tn
  FROM soft JOIN rk USING (id) GROUP BY 1, 2), c AS (SELECT chunk, -avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn + 1e-12) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp + 1e-12) ELSE 0 END - 1) AS loss FROM ex GROUP BY 1)
SELECT round(avg(loss), 6) + 0.0 AS loss FROM c""")
def _(spark, sf):
    return rnd(X.chunked_expected_score(soft(spark, sf), "id", 64, "probs", "y"), ["loss"])


@query("m31_focal_score", f"""WITH {LONG}, t AS (SELECT ln(p) AS l, p, [0.5, 1.0, 2.0, 4.0][y + 1] AS a FROM soft WHERE j = y)
SELECT round(avg(-a * pow(greatest(1 - p, 1e-8), 2) * l), 6) AS weighted, round(avg(-pow(greatest(1 - p, 1e-8), 2) * l), 6) AS plain FROM t""")
def _(spark, sf):
    d = logits(spark, sf)
    w = X.focal_score(d, "logits", "y", 2.0, [0.5, 1.0, 2.0, 4.0]).select(r6("loss").alias("weighted"))
    p = X.focal_score(d, "logits", "y", 2.0).select(r6("loss").alias("plain"))
    return w.withColumn("plain", p.scalar())


@query("m33_cross_entropy", f"""WITH {LONG}, t AS (SELECT -ln(p) AS nll, [1.0, 2.0, 3.0, 4.0][y + 1] AS w FROM soft WHERE j = y) SELECT round(sum(w * nll) / sum(w), 6) AS loss FROM t""")
def _(spark, sf):
    return rnd(X.cross_entropy(logits(spark, sf), "logits", "y", [1.0, 2.0, 3.0, 4.0]), ["loss"])


def ovr_sql(src: str, k: int) -> str:
    """One-vs-rest counts ``ov`` of the ``k`` classes of ``src`` (y, h)."""
    def n(test: str) -> str:
        return f"CAST(count(CASE WHEN {test} THEN 1 END) AS DOUBLE)"
    return f"""ov AS (SELECT c AS cls, {n('y = c AND h = c')} AS tp, {n('y <> c AND h = c')} AS fp, {n('y = c AND h <> c')} AS fn, {n('y <> c AND h <> c')} AS tn
  FROM (SELECT unnest(range({k})) AS c) kc CROSS JOIN {src} GROUP BY 1)"""


MEANS = """pf AS (SELECT tp, fp, fn, tp + fn AS s, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM ov),
o AS (SELECT sum(tp) AS c, sum(tp + fn) AS s, sum((tp + fp) * (tp + fn)) AS pt, sum((tp + fp) * (tp + fp)) AS pp, sum((tp + fn) * (tp + fn)) AS tt FROM ov),
mean AS (SELECT 'accuracy' AS metric, sum(tp) / sum(tp + fn) AS value FROM ov
UNION ALL SELECT unnest(['precision', 'recall', 'f1_weighted', 'f1_micro', 'f1_macro']), unnest([sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), avg(f)]) FROM pf
UNION ALL SELECT 'mcc_rk', (c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) FROM o)"""

#: ``flat`` (metric, value): the whole report of three classes or more, from ``ov``.
FLAT = f"""{MICRO[len(CM) + 2:]}, {rates_sql('ov')}, {MEANS}, flat AS (SELECT * FROM mean
UNION ALL SELECT unnest(['tpr_macro', 'tnr_macro', 'tss_macro', 'hss_macro', 'gss_macro']), unnest([avg(tpr), avg(tnr), avg(tss), avg(hss), avg(gss)]) FROM sk
UNION ALL SELECT unnest(['tpr_weighted', 'tnr_weighted', 'tss_weighted', 'hss_weighted', 'gss_weighted']), unnest([sum(tpr * support) / (sum(support) + 1e-7), sum(tnr * support) / (sum(support) + 1e-7), sum(tss * support) / (sum(support) + 1e-7), sum(hss * support) / (sum(support) + 1e-7), sum(gss * support) / (sum(support) + 1e-7)]) FROM sk
UNION ALL SELECT unnest(['tp_micro', 'fp_micro', 'fn_micro', 'tn_micro', 'n_micro', 'tpr_micro', 'tnr_micro', 'ppv_micro', 'npv_micro', 'fpr_micro', 'fnr_micro', 'fdr_micro', 'tss_micro', 'hss_micro', 'gss_micro', 'accuracy_micro']),
  unnest([tp, fp, fn, tn, n, tpr, tnr, ppv, npv, fpr, fnr, fdr, tpr + tnr - 1, 2 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn) + 1e-7), (tp - ch) / (tp + fp + fn - ch + 1e-7), (tp + tn) / (n + 1e-7)]) FROM mi)"""


def flat_binary_sql(eps: str = "1e-12") -> str:
    """``flat`` (metric, value): the whole report of two classes, from ``ov``."""
    names = "tp fp fn tn tpr tnr ppv npv fpr fnr fdr acc tss hss gss mcc apss".split()
    return f"""pos AS (SELECT tp, fp, fn, tn FROM ov WHERE cls = 1), {rates_sql('pos', eps)}, {MEANS},
bp AS (SELECT *, tp / (tp + fp + {eps}) AS pp, tp / (tp + fn + {eps}) AS rp, tn / (tn + fn + {eps}) AS pn, tn / (tn + fp + {eps}) AS rn FROM pos),
flat AS (SELECT * FROM mean UNION ALL SELECT unnest({names}), unnest([{', '.join(names)}]) FROM sk
UNION ALL SELECT unnest(['f1_pos', 'f1_neg', 'tss_pos', 'tss_neg']), unnest([2 * pp * rp / (pp + rp + {eps}), 2 * pn * rn / (pn + rn + {eps}), rp + rn - 1, rp + rn - 1]) FROM bp)"""


@query("m34_flat_report", f"WITH {CM}, {FLAT} SELECT metric, round(value, 6) + 0.0 AS value FROM flat")
def _(spark, sf):
    return rnd(M.summary_metrics(classes(spark, sf), "y", "yhat", 3), ["value"])


@query("m35_prediction_report", f"""WITH {TOP}, z AS (SELECT CASE WHEN a.y >= 2 THEN 1 ELSE 0 END AS y, CASE WHEN a.j >= 2 THEN 1 ELSE 0 END AS h FROM (SELECT am.id, lg.y, am.j FROM am JOIN lg USING (id) WHERE am.k = 1) a),
{ovr_sql('z', 2)}, {flat_binary_sql('1e-7')} SELECT metric, round(value, 6) + 0.0 AS value FROM flat""")
def _(spark, sf):
    return rnd(M.prediction_report(named(spark, sf), scheme="binary", threshold="M"), ["value"])


@query("m35_prediction_report_classes", f"""WITH {TOP}, z AS (SELECT lg.y, am.j AS h FROM am JOIN lg USING (id) WHERE am.k = 1),
{ovr_sql('z', 4)}, {FLAT} SELECT metric, round(value, 6) + 0.0 AS value FROM flat""")
def _(spark, sf):
    return rnd(M.prediction_report(named(spark, sf, False), eps=1e-12), ["value"])


def named(spark, sf, both: bool = True):
    """Predictions with class names; both spellings of the positive class occur in prediction files."""
    from flareframe.operators.predictions import decode
    d = decode(logits(spark, sf), "logits", "multi", labels=LABELS)
    pred = F.when(F.col("label_pred") == "X", "M+").otherwise(F.col("label_pred")) if both else F.col("label_pred")
    return d.select(F.element_at(F.array(*[F.lit(c) for c in LABELS]), F.col("y").cast("int") + 1).alias("label"), pred.alias("label_pred"))
