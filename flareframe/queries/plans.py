"""Whole workflows: flux windows, augmented clips, clip dataset, verification; S14-S16."""

from __future__ import annotations

from pyspark.sql import functions as F

from flareframe.operators import grid as G
from flareframe.plans import clip_dataset, datasets, feature_series, flux_windows, verification
from flareframe.queries.inputs import (BACKGROUND, CLASS_SQL, HOURLY, SCORES, SEV_SQL, background, flare_events, flux,
                                       frames, r6, scores, stamp, table)
from flareframe.queries.metrics import curve_sql, flat_binary_sql, ovr_sql
from flareframe.queries.registry import query
from flareframe.queries.sequences import CLIPS, ISLANDS, T, clips

# every event is a flare; those of value up to 300 are of the lowest class, so the others are rare, like the real thing
STRONG = f"""strong AS (SELECT event_id AS id, ts AS t_occ, CASE WHEN value > 300 THEN {SEV_SQL} ELSE 1 END AS sev,
  CASE WHEN value > 300 THEN {CLASS_SQL} ELSE 'A' END AS class, ts AS a,
  ts + to_minutes(CAST(CAST(floor(value) AS BIGINT) % 60 AS BIGINT)) AS b FROM events)"""


def strong(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("value") > 300).alias("big"))
    f = flare_events(spark, sf).join(e, "id")
    cls = F.when(F.col("big"), F.col("class")).otherwise("A")
    return f.withColumns({"class": cls, "sev": F.when(F.col("big"), F.col("sev")).otherwise(1),
                          "flare_type": F.concat(cls, F.lit("1.0"))}).drop("big")


WIN = f"""{HOURLY}, {BACKGROUND}, {STRONG}, w0 AS (SELECT satellite, background, unnest(generate_series(CAST(date AS TIMESTAMP), CAST(date AS TIMESTAMP) + INTERVAL 12 HOUR, INTERVAL 12 HOUR)) AS s FROM bgday),
w1 AS (SELECT *, s + INTERVAL 24 HOUR AS e FROM w0),
hist AS (SELECT t.ts, max(CASE WHEN x.id IS NULL THEN 0 ELSE x.sev END) AS hist FROM (SELECT DISTINCT ts FROM hourly) t LEFT JOIN strong x ON t.ts >= x.a AND t.ts <= x.b GROUP BY 1),
pt AS (SELECT w1.satellite, s, background, h.ts, h.flux, hist.hist, date_diff('hour', s, h.ts) AS pos FROM w1 JOIN hourly h ON h.satellite = w1.satellite AND h.ts >= s AND h.ts < e JOIN hist ON hist.ts = h.ts),
k AS (SELECT *, row_number() OVER (PARTITION BY satellite, s ORDER BY ts) AS rk, last_value(CASE WHEN flux IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p0, last_value(flux IGNORE NULLS) OVER a AS v0,
  first_value(CASE WHEN flux IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p1, first_value(flux IGNORE NULLS) OVER b AS v1 FROM pt
  WINDOW a AS (PARTITION BY satellite, s ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY satellite, s ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ra AS (SELECT *, CAST(CASE WHEN flux IS NOT NULL THEN flux WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (CAST(pos - p0 AS DOUBLE) / (p1 - p0)) END / background AS FLOAT) AS ratio FROM k),
ag AS (SELECT satellite, s, count(*) AS n_points, count(flux) AS n_valid, sum(CAST(ratio AS DOUBLE) * rk) AS check_ratio, sum(hist * rk) AS check_hist FROM ra GROUP BY 1, 2),
lb AS (SELECT w1.satellite, s, max(CASE WHEN t_occ > e + INTERVAL 2 HOUR AND t_occ <= e + INTERVAL 26 HOUR THEN sev END) AS ahead, max(CASE WHEN t_occ >= s AND t_occ <= e THEN sev END) AS inside FROM w1 LEFT JOIN strong ON t_occ >= s AND t_occ <= e + INTERVAL 26 HOUR GROUP BY 1, 2),
fw AS (SELECT w1.satellite, w1.s, w1.e, coalesce(n_points, 0) AS n_points, CASE WHEN coalesce(CAST(n_valid AS DOUBLE) / n_points, 0) < 0.85 THEN 'coverage' WHEN inside >= 5 THEN 'event' ELSE 'ok' END AS reason,
  CASE ahead WHEN 5 THEN 'X' WHEN 4 THEN 'M' WHEN 3 THEN 'C' ELSE 'NONE' END AS label, check_ratio, check_hist FROM w1 LEFT JOIN ag USING (satellite, s) LEFT JOIN lb USING (satellite, s))"""


def labelled(spark, sf):
    return flux_windows.label_windows(
        flux(spark, sf), background(spark, sf), strong(spark, sf), every="1 hour", width="24 hours",
        stride="12 hours", min_coverage=0.85, gap="2 hours", skip_at_least="X", history="ordinal")


def weighted(c):
    return F.aggregate(F.transform(c, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)


@query("e1_flux_windows", f"WITH {WIN} SELECT satellite, strftime(s, {T}) AS date_start, reason, label, CAST(n_points AS BIGINT) AS n_points, round(check_ratio, 3) AS check_ratio, CAST(check_hist AS DOUBLE) AS check_hist FROM fw")
def _(spark, sf):
    d = labelled(spark, sf)
    return d.select("satellite", "date_start", "reason", "label", F.coalesce("n_points", F.lit(0)).alias("n_points"),
                    r6(weighted("xrs_flux_ratio"), 3).alias("check_ratio"), weighted("flare_hist").alias("check_hist"))


@query("e1_skip_rules", f"""WITH {HOURLY}, {BACKGROUND}, w AS (SELECT satellite, CAST(date AS TIMESTAMP) AS s FROM bgday)
SELECT satellite, strftime(s, {T}) AS date_start, CASE WHEN s < TIMESTAMP '2024-02-01' THEN 'date_range' ELSE 'ok' END AS reason FROM w""")
def _(spark, sf):
    d = flux_windows.label_windows(flux(spark, sf), background(spark, sf), strong(spark, sf), every="1 hour",
                                   min_coverage=0.0, skip_years=[1999], skip_ranges=["2023-12:2024-01"])
    return d.select("satellite", "date_start", "reason")


@query("s14_flat_windows", f"""WITH {WIN}, f AS (SELECT satellite, s, label FROM fw WHERE reason = 'ok' AND n_points = 24)
SELECT strftime(ra.s, {T}) AS t0, f.label, round(sum(CAST(ratio AS DOUBLE)), 3) AS total, round(sum(CASE WHEN pos = 0 THEN CAST(ratio AS DOUBLE) END), 4) AS r1, round(sum(CASE WHEN pos = 23 THEN CAST(ratio AS DOUBLE) END), 4) AS r24,
  sum(CASE WHEN pos = 23 THEN CAST(hist AS DOUBLE) END) AS h24 FROM ra JOIN f USING (satellite, s) GROUP BY ra.satellite, 1, 2""")
def _(spark, sf):
    d = labelled(spark, sf).where("reason = 'ok'")
    f = flux_windows.flatten_windows(d, 24, include_history=True)
    total = sum((F.col(f"r{i}").cast("double") for i in range(1, 25)), F.lit(0.0))
    return f.select("t0", "label", r6(total, 3).alias("total"), r6("r1", 4).alias("r1"), r6("r24", 4).alias("r24"),
                    F.col("h24").cast("double").alias("h24"))


@query("s16_window_index", f"WITH {WIN} SELECT satellite, strftime(s, {T}) AS start_time, strftime(e, {T}) AS end_time, label, CAST(n_points AS BIGINT) AS n_points, true AS has_hist FROM fw WHERE reason = 'ok'")
def _(spark, sf):
    return flux_windows.window_index(labelled(spark, sf).where("reason = 'ok'"))


# one instrument: all event types together, on a 15-minute grid
AUG = f"""{CLIPS}, {STRONG}, qb AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS flux FROM events GROUP BY 1),
bg AS (SELECT CAST(ts AS DATE) AS date, max(value) AS background FROM events GROUP BY 1),
pt AS (SELECT ar, t_start, t_end, unnest(generate_series(0, 15)) AS pos FROM clips),
pv AS (SELECT pt.*, qb.flux, bg.background FROM (SELECT *, t_start + to_minutes(15 * pos) AS ts FROM pt) pt LEFT JOIN qb ON qb.ts = pt.ts LEFT JOIN bg ON bg.date = CAST(pt.ts AS DATE)),
k AS (SELECT *, last_value(CASE WHEN flux IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p0, last_value(flux IGNORE NULLS) OVER a AS v0,
  first_value(CASE WHEN flux IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p1, first_value(flux IGNORE NULLS) OVER b AS v1 FROM pv
  WINDOW a AS (PARTITION BY ar, t_start ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY ar, t_start ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ra AS (SELECT *, CAST(CASE WHEN flux IS NOT NULL THEN flux WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (CAST(pos - p0 AS DOUBLE) / (p1 - p0)) END / background AS FLOAT) AS ratio FROM k),
ag AS (SELECT ar, t_start, count(flux) / 16.0 AS cov, sum(CAST(ratio AS DOUBLE) * (pos + 1)) AS chk FROM ra GROUP BY 1, 2),
lb AS (SELECT c.ar, c.t_start, max(sev) AS sev FROM clips c LEFT JOIN strong ON t_occ > t_end + INTERVAL 1 HOUR AND t_occ <= t_end + INTERVAL 13 HOUR GROUP BY 1, 2),
au AS (SELECT ar, t_start, CASE WHEN cov < 0.95 THEN 'coverage' END AS error, chk, CASE sev WHEN 5 THEN 'X' WHEN 4 THEN 'M' WHEN 3 THEN 'C' ELSE 'NONE' END AS ts_type FROM ag JOIN lb USING (ar, t_start))"""


def augmented(spark, sf):
    e = table(spark, sf, "events")
    f = e.groupBy(G.bin_start("ts", "15 minutes").alias("ts")).agg(F.avg("value").alias("flux"))
    bg = e.groupBy(G.day_of("ts").alias("date")).agg(F.max("value").alias("background"))
    c = clips(spark, sf).withColumn("cid", F.concat_ws("_", F.col("ar").cast("string"), F.date_format("t_start", "yyyyMMddHH")))
    return datasets.augment_clips(c, f, bg, strong(spark, sf), "cid", "15 minutes", 0.95, "12 hours", "1 hour")


@query("e2_augmented_clips", f"""WITH {AUG} SELECT ar, strftime(t_start, {T}) AS t, error, CASE WHEN error IS NULL THEN round(chk, 3) END AS chk, CASE WHEN error IS NULL THEN ts_type END AS ts_type,
  CAST(CASE WHEN error IS NULL THEN 16 END AS BIGINT) AS n FROM au""")
def _(spark, sf):
    return augmented(spark, sf).select(
        "ar", stamp("t_start").alias("t"), F.col("xrs_error").alias("error"), r6(weighted("xrs_flux_ratio"), 3).alias("chk"),
        F.col("flare_ts_type").alias("ts_type"), F.col("n_minutes").cast("long").alias("n"))


@query("e4_feature_series", f"""WITH {ISLANDS},
st AS (SELECT a.ar, a.island, a.pos AS start_pos FROM isl a WHERE a.pos % 2 = 0 AND EXISTS (SELECT 1 FROM isl z WHERE z.ar = a.ar AND z.island = a.island AND z.pos = a.pos + 2)),
m AS (SELECT st.ar, st.island, st.start_pos, i.ts, i.v, i.label, i.pos - st.start_pos AS k FROM st JOIN isl i ON i.ar = st.ar AND i.island = st.island AND i.pos BETWEEN start_pos AND start_pos + 2),
z AS (SELECT avg(v) AS a, stddev_pop(v) AS b FROM m)
SELECT ar, strftime(min(ts), {T}) AS date_start, strftime(max(ts), {T}) AS date_end, arg_max(label, ts) AS flare_type, count(*) AS npoints, CAST(60 AS BIGINT) AS dt,
  round(sum((v - a) / b * (k + 1)), 4) + 0.0 AS feat1, round(sum((v - a) / b * (k + 1)), 4) + 0.0 AS feat29 FROM m, z GROUP BY ar, island, start_pos""")
def _(spark, sf):
    f = frames(spark, sf)
    rows = f.select("ar", "ts", F.transform(F.sequence(F.lit(0), F.lit(28)), lambda i: F.col("v") + i).alias("features"),
                    F.when(F.col("label") == "NONE", "0.0").otherwise(F.concat("label", F.lit(" 1.0"))).alias("reg_label"))
    d = feature_series.normalise(feature_series.build(rows, 3, "1 hour", "24 hours", stride=2), "zscore")
    return d.select("ar", "date_start", "date_end", "flare_type", "npoints", "dt", r6(weighted("feat1"), 4).alias("feat1"),
                    r6(weighted("feat29"), 4).alias("feat29"))


@query("e2_clip_dataset")
def _(spark, sf):
    f = frames(spark, sf)
    d = clip_dataset.build(f, 3, "1 hour", "1 hour", targets={"NONE": 200, "C": 300}, scheme="binary",
                           threshold="M")
    return d.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ar").alias("n_groups"))


# the same scores through a logistic curve, as single logits
LOGISTIC = SCORES.replace("scores AS", "s0 AS", 1) + ", scores AS (SELECT id, 1 / (1 + exp(-(8 * p - 4))) AS p, y, run FROM s0)"


@query("e3_verification", f"""WITH {LOGISTIC}, z AS (SELECT y, CASE WHEN p >= 0.4 THEN 1 ELSE 0 END AS h FROM scores), {ovr_sql('z', 2)}, {flat_binary_sql()}, {curve_sql(1001)},
m AS (SELECT avg((p - y) * (p - y)) AS mse, avg(y) AS o, sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn, sum((1 - y) * (1 - p)) AS tn, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM scores),
ex AS (SELECT tp / (tp + fn) + tn / (tn + fp) - 1 AS t, n1, n0 FROM m),
at_ AS (SELECT 'tss' AS c, threshold, tss, f1, mcc, row_number() OVER (ORDER BY tss DESC, tick) AS k FROM cv UNION ALL SELECT 'f1', threshold, tss, f1, mcc, row_number() OVER (ORDER BY f1 DESC, tick) FROM cv
  UNION ALL SELECT 'mcc', threshold, tss, f1, mcc, row_number() OVER (ORDER BY mcc DESC, tick) FROM cv
  UNION ALL SELECT 'precrec', threshold, tss, f1, mcc, row_number() OVER (ORDER BY precision > 0 AND recall > 0 DESC, abs(precision - recall), tick) FROM cv),
u AS (SELECT * FROM flat UNION ALL SELECT 'bss', 1 - mse / (o * (1 - o)) FROM m
UNION ALL SELECT unnest(['tss_expected_average', 'tss_expected_weighted']), unnest([t, t]) FROM ex
UNION ALL SELECT unnest(['threshold', 'tss', 'f1', 'mcc']) || '_at_best_' || c, unnest([threshold, tss, f1, mcc]) FROM at_ WHERE k = 1) SELECT metric, round(value, 6) + 0.0 AS value FROM u""")
def _(spark, sf):
    d = scores(spark, sf).withColumn("lg", F.array(F.col("p") * 8 - 4))
    return verification.verify(d, "lg", "y", ["NONE", "M+"], 0.4).withColumn("value", r6("value"))
