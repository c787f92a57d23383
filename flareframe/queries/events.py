"""Flux grids, windows and events: A01-A02, W08-W09, J01-J05, F05-F07, T01-T02, S08."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flareframe.functions import labels as L
from flareframe.operators import events as E
from flareframe.operators import grid as G
from flareframe.operators.ordered import micros
from flareframe.queries.inputs import (BACKGROUND, FLARES, FLUX, HOURLY, SEV_SQL, background,
                                       flare_events, flux, items, r6, sev_to_class_sql, stamp)
from flareframe.queries.registry import query

KEY = ["satellite"]


def hourly(spark, sf):
    return G.resample_mean(flux(spark, sf), KEY, "ts", "flux", "1 hour")


@query("s08_normalise_events", f"""WITH {FLARES}
SELECT strftime(CASE WHEN id % 3 = 0 THEN timestamp_start ELSE timestamp_start + INTERVAL 1 MINUTE END, '%Y-%m-%d %H:%M:%S') AS t_occ, class,
  CAST(sev AS BIGINT) AS sev, strftime(timestamp_start, '%Y-%m-%d %H:%M:%S') AS t_start,
  CASE WHEN id % 5 <> 0 THEN strftime(timestamp_end, '%Y-%m-%d %H:%M:%S') END AS t_end FROM flares WHERE id % 7 <> 0""")
def _(spark, sf):
    d = flare_events(spark, sf)
    fmt = "yyyy-MM-dd HH:mm:ss"
    minute = micros("t_occ") + 60_000_000
    raw = d.select(
        F.when(F.col("id") % 3 == 0, "not a time").otherwise(
            F.date_format(G.from_micros(minute), fmt)).alias("TimeStamp"),
        F.date_format("timestamp_start", fmt).alias("start_time"),
        F.when(F.col("id") % 5 != 0, F.date_format("timestamp_end", fmt)).alias("timestamp_END"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit(" "), F.lower("class"), F.lit("2.2")))
        .otherwise("?").alias("Class"))
    e = E.normalise_events(raw)
    return e.select(stamp("t_occ").alias("t_occ"), "class", F.col("sev").cast("long").alias("sev"),
                    stamp("timestamp_start").alias("t_start"), stamp("timestamp_end").alias("t_end"))


@query("s08_read_events", f"""WITH {FLARES} SELECT strftime(timestamp_start, '%Y-%m-%d %H:%M:%S') AS t_occ, class, CAST(sev AS BIGINT) AS sev,
  CASE WHEN id % 5 <> 0 THEN strftime(timestamp_end, '%Y-%m-%d %H:%M:%S') END AS t_end FROM flares WHERE id % 7 <> 0""")
def _(spark, sf):
    from flareframe.session import shared_dir
    from flareframe.sources.readers import read_events
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    flare_events(spark, sf).select(
        stamp("timestamp_start").alias("Start_Time"),
        F.when(F.col("id") % 5 != 0, stamp("timestamp_end")).alias("timestamp_end"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lower("class"), F.lit("1.0"))).alias("CLASS")
    ).write.option("header", True).csv(path)
    return read_events(spark, path).select(stamp("t_occ").alias("t_occ"), "class", F.col("sev").cast("long").alias("sev"),
                                           stamp("timestamp_end").alias("t_end"))


@query("a01_resample_mean", f"WITH {HOURLY} SELECT satellite, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, round(flux, 6) AS flux FROM hourly")
def _(spark, sf):
    return hourly(spark, sf).select("satellite", stamp("ts").alias("t"), r6("flux").alias("flux"))


@query("a02_first_per_day", f"""WITH {FLUX}, {BACKGROUND} SELECT satellite, strftime(date, '%Y-%m-%d') AS date,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, background FROM bgday""")
def _(spark, sf):
    d = G.first_per_day(background(spark, sf), KEY, "ts", "background")
    return d.select("satellite", F.date_format("date", "yyyy-MM-dd").alias("date"),
                    stamp("ts").alias("t"), "background")


@query("a06_worst_class", """SELECT user_id AS ar, CASE max(CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 ELSE 1 END)
  WHEN 5 THEN 'X' WHEN 4 THEN 'M' WHEN 3 THEN 'C' WHEN 2 THEN 'B' ELSE 'A' END AS worst FROM events GROUP BY 1""")
def _(spark, sf):
    return items(spark, sf).groupBy("ar").agg(
        L.class_of_severity(F.max(L.severity(F.col("flare_type")))).alias("worst"))


WINDOWS = f"""{FLUX}, {BACKGROUND}, win AS (SELECT satellite, background, unnest(generate_series(CAST(date AS TIMESTAMP),
  CAST(date AS TIMESTAMP) + INTERVAL 18 HOUR, INTERVAL 6 HOUR)) AS s FROM bgday),
w AS (SELECT satellite, background, s, s + INTERVAL 24 HOUR AS e FROM win)"""


def windows(spark, sf, width="24 hours", stride="6 hours"):
    bg = G.first_per_day(background(spark, sf), KEY, "ts", "background")
    return G.day_windows(bg, KEY, "ts", width, stride)


@query("w08_day_windows", f"""WITH {WINDOWS} SELECT satellite, strftime(s, '%Y-%m-%d %H:%M:%S') AS s, strftime(e, '%Y-%m-%d %H:%M:%S') AS e FROM w""")
def _(spark, sf):
    return windows(spark, sf).select("satellite", stamp("start").alias("s"), stamp("end").alias("e"))


@query("w08_background_aligned", f"""WITH {FLUX}, {BACKGROUND}, b AS (SELECT satellite, CAST(date AS TIMESTAMP) AS d0, ts + INTERVAL 90 MINUTE AS a FROM bgday),
g AS (SELECT satellite, d0, unnest(generate_series(a, d0 + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND, INTERVAL 5 HOUR)) AS s FROM b)
SELECT satellite, strftime(s, '%Y-%m-%d %H:%M:%S') AS s, strftime(s + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS e FROM g""")
def _(spark, sf):
    bg = G.first_per_day(background(spark, sf), KEY, "ts", "background")
    bg = bg.withColumn("ts", G.from_micros(micros("ts") + 90 * 60_000_000))
    w = G.day_windows(bg, KEY, "ts", "12 hours", "5 hours", "background")
    return w.select("satellite", stamp("start").alias("s"), stamp("end").alias("e"))


@query("w08_window_points", f"""WITH {HOURLY}, {BACKGROUND},
win AS (SELECT satellite, unnest(generate_series(CAST(date AS TIMESTAMP), CAST(date AS TIMESTAMP) + INTERVAL 18 HOUR, INTERVAL 6 HOUR)) AS s FROM bgday)
SELECT win.satellite, strftime(s, '%Y-%m-%d %H:%M:%S') AS s, count(*) AS n_points, count(flux) AS n_valid, round(sum(flux), 8) AS total
FROM win JOIN hourly h ON h.satellite = win.satellite AND h.ts >= s AND h.ts < s + INTERVAL 24 HOUR GROUP BY 1, 2""")
def _(spark, sf):
    p = G.window_points(hourly(spark, sf), windows(spark, sf), KEY, "ts", "1 hour", "24 hours")
    return p.groupBy("satellite", stamp("start").alias("s")).agg(
        F.count(F.lit(1)).alias("n_points"), F.count("flux").alias("n_valid"),
        r6(F.sum("flux"), 8).alias("total"))


QUARTER = FLUX + """, qb AS (SELECT satellite, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(flux) AS flux FROM flux GROUP BY 1, 2),
qg AS (SELECT satellite, unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTE)) AS ts FROM qb GROUP BY 1),
q AS (SELECT qg.satellite, qg.ts, qb.flux, row_number() OVER (PARTITION BY qg.satellite ORDER BY qg.ts) AS pos
  FROM qg LEFT JOIN qb ON qg.satellite = qb.satellite AND qg.ts = qb.ts)"""


@query("w09_fill_linear", f"""WITH {QUARTER},
k AS (SELECT *, last_value(CASE WHEN flux IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p0, last_value(flux IGNORE NULLS) OVER a AS v0,
  first_value(CASE WHEN flux IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p1, first_value(flux IGNORE NULLS) OVER b AS v1 FROM q
  WINDOW a AS (PARTITION BY satellite ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY satellite ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT satellite, pos, round(CASE WHEN flux IS NOT NULL THEN flux WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0
  ELSE v0 + (v1 - v0) * (CAST(pos - p0 AS DOUBLE) / (p1 - p0)) END, 8) AS flux FROM k""")
def _(spark, sf):
    from flareframe.operators.ordered import number_rows, time_segment
    q = G.resample_mean(flux(spark, sf), KEY, "ts", "flux", "15 minutes")
    q = number_rows(q, KEY, ["ts"], time_segment("ts", "1 day"), "pos")
    return G.fill_linear(q, KEY, "pos", "flux", F.floor(F.col("pos") / 256)) \
        .select("satellite", "pos", r6("flux", 8).alias("flux"))


@query("j05_align", f"""WITH {FLUX}, m AS (SELECT satellite, date_trunc('minute', ts) AS ts, max(flux) AS flux FROM flux GROUP BY 1, 2),
r AS (SELECT satellite, min(ts) AS a, max(ts) AS b FROM m GROUP BY 1), g AS (SELECT satellite, unnest(generate_series(a, b, INTERVAL 1 MINUTE)) AS ts FROM r)
SELECT g.satellite, CAST(CAST(g.ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(flux) AS n_valid, round(sum(flux), 8) AS total FROM g LEFT JOIN m ON g.satellite = m.satellite AND g.ts = m.ts GROUP BY 1, 2""")
def _(spark, sf):
    m = flux(spark, sf).groupBy("satellite", G.bin_start("ts", "1 minute").alias("ts")) \
        .agg(F.max("flux").alias("flux"))
    grid = G.make_grid(m.groupBy("satellite").agg(F.min("ts").alias("a"), F.max("ts").alias("b")),
                       KEY, "a", "b", "ts", "1 minute")
    return G.align(grid, m, KEY, "ts").groupBy("satellite", G.day_of("ts").cast("string").alias("day")) \
        .agg(F.count(F.lit(1)).alias("n"), F.count("flux").alias("n_valid"), r6(F.sum("flux"), 8).alias("total"))


@query("j01_background_ratio", f"""WITH {HOURLY}, {BACKGROUND} SELECT h.satellite, strftime(h.ts, '%Y-%m-%d %H:%M:%S') AS t,
  round(CASE WHEN background > 0 THEN flux / background END, 8) AS ratio FROM hourly h LEFT JOIN bgday b ON h.satellite = b.satellite AND CAST(h.ts AS DATE) = b.date""")
def _(spark, sf):
    bg = G.first_per_day(background(spark, sf), KEY, "ts", "background")
    p = hourly(spark, sf).withColumn("date", G.day_of("ts")).join(
        bg.select("satellite", "date", "background"), ["satellite", "date"], "left")
    ratio = F.when(G.valid_background(F.col("background")), F.col("flux") / F.col("background"))
    return p.select("satellite", stamp("ts").alias("t"), r6(ratio, 8).alias("ratio"))


@query("t01_flux_ratio", f"""WITH {HOURLY}, {BACKGROUND}
SELECT h.satellite, CAST(h.ts AS DATE)::VARCHAR AS day, count(CASE WHEN background > 0 THEN flux END) AS n,
  round(sum(CASE WHEN background > 0 THEN CAST(flux / background AS FLOAT) END), 3) AS total FROM hourly h LEFT JOIN bgday b ON h.satellite = b.satellite AND CAST(h.ts AS DATE) = b.date GROUP BY 1, 2""")
def _(spark, sf):
    bg = G.first_per_day(background(spark, sf), KEY, "ts", "background")
    d = G.flux_ratio(hourly(spark, sf), bg, KEY, "ts")
    return d.groupBy("satellite", G.day_of("ts").cast("string").alias("day")).agg(
        F.count("ratio").alias("n"), r6(F.sum("ratio"), 3).alias("total"))


# one window per entity (user) and day it was seen on, ending at midnight
DAYS = f"""{FLARES}, fu AS (SELECT user_id AS ar, event_id AS id, ts AS t_occ, {SEV_SQL} AS sev FROM events),
d AS (SELECT DISTINCT ar, CAST(CAST(t_occ AS DATE) AS TIMESTAMP) AS s, CAST(CAST(t_occ AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS e FROM fu)"""


def user_events(spark, sf):
    return items(spark, sf).select("ar", F.col("ts").alias("t_occ"),
                                   L.severity(F.col("flare_type")).alias("sev"))


def user_days(spark, sf):
    s = G.day_of("ts").cast("timestamp_ntz")
    return items(spark, sf).select("ar", s.alias("start"),
                                   G.from_micros(micros(s) + G.DAY).alias("end")).distinct()


@query("j02_label_ahead", f"""WITH {DAYS} SELECT d.ar, strftime(e, '%Y-%m-%d') AS day, {sev_to_class_sql('max(sev)')} AS flare_class
FROM d LEFT JOIN fu ON d.ar = fu.ar AND t_occ > e + INTERVAL 2 HOUR AND t_occ <= e + INTERVAL 14 HOUR GROUP BY 1, 2""")
def _(spark, sf):
    w = E.label_ahead(user_days(spark, sf), user_events(spark, sf), ["ar"], "end", "12 hours", "2 hours")
    return w.select("ar", F.date_format("end", "yyyy-MM-dd").alias("day"), "flare_class")


@query("j02_null_end", f"""WITH {DAYS} SELECT d.ar, strftime(s, '%Y-%m-%d') AS day, CASE WHEN d.ar % 3 = 0 THEN 'NONE' ELSE {sev_to_class_sql('max(sev)')} END AS flare_class
FROM d LEFT JOIN fu ON d.ar = fu.ar AND t_occ > e AND t_occ <= e + INTERVAL 12 HOUR GROUP BY 1, 2""")
def _(spark, sf):
    d = user_days(spark, sf).withColumn("end", F.when(F.col("ar") % 3 != 0, F.col("end")))
    w = E.label_ahead(d, user_events(spark, sf), ["ar"], "end", "12 hours")
    return w.select("ar", F.date_format("start", "yyyy-MM-dd").alias("day"), "flare_class")


@query("j03_events_within", f"""WITH {DAYS} SELECT d.ar, strftime(e, '%Y-%m-%d') AS day, CAST(coalesce(max(sev), 0) AS BIGINT) AS sev
FROM d LEFT JOIN fu ON d.ar = fu.ar AND t_occ >= s + INTERVAL 6 HOUR AND t_occ <= e GROUP BY 1, 2""")
def _(spark, sf):
    w = user_days(spark, sf).withColumn("start", G.from_micros(micros("start") + 6 * 3_600_000_000))
    w = E.events_within(w, user_events(spark, sf), ["ar"], "start", "end", "sev")
    return w.select("ar", F.date_format("end", "yyyy-MM-dd").alias("day"), F.col("sev").cast("long").alias("sev"))


@query("f07_no_event_at_least", f"""WITH {DAYS} SELECT d.ar, strftime(e, '%Y-%m-%d') AS day FROM d WHERE NOT EXISTS
  (SELECT 1 FROM fu WHERE fu.ar = d.ar AND sev >= 4 AND t_occ >= s AND t_occ <= e)""")
def _(spark, sf):
    w = E.no_event_at_least(user_days(spark, sf), user_events(spark, sf), ["ar"], "start", "end", "M")
    return w.select("ar", F.date_format("end", "yyyy-MM-dd").alias("day"))


# 10-minute grid per entity, events of that entity in progress
GRID10 = f"""{FLARES}, r AS (SELECT ar, date_trunc('hour', min(t_occ)) AS a, date_trunc('hour', max(t_occ)) AS b FROM flares GROUP BY 1),
g AS (SELECT ar, unnest(generate_series(a, b, INTERVAL 10 MINUTE)) AS ts FROM r)"""


def grid10(spark, sf):
    f = flare_events(spark, sf, keyed=True)
    r = f.groupBy("ar").agg(G.bin_start(F.min("t_occ"), "1 hour").alias("a"),
                            G.bin_start(F.max("t_occ"), "1 hour").alias("b"))
    return G.make_grid(r, ["ar"], "a", "b", "ts", "10 minutes"), f


@query("j04_history_ordinal", f"""WITH {GRID10} SELECT g.ar, strftime(g.ts, '%Y-%m-%d %H:%M:%S') AS t, CAST(coalesce(max(sev), 0) AS DOUBLE) AS hist
FROM g LEFT JOIN flares f ON f.ar = g.ar AND g.ts >= timestamp_start AND g.ts <= timestamp_end GROUP BY 1, 2""")
def _(spark, sf):
    g, f = grid10(spark, sf)
    h = E.history_channel(g, f, ["ar"], "ts", "ordinal")
    return h.select("ar", stamp("ts").alias("t"), F.col("hist").cast("double").alias("hist"))


@query("t02_history_binary", f"""WITH {GRID10} SELECT g.ar, strftime(g.ts, '%Y-%m-%d %H:%M:%S') AS t, CAST(max(CASE WHEN f.id IS NULL THEN 0 ELSE 1 END) AS DOUBLE) AS hist
FROM g LEFT JOIN flares f ON f.ar = g.ar AND g.ts >= timestamp_start AND g.ts <= timestamp_end GROUP BY 1, 2""")
def _(spark, sf):
    g, f = grid10(spark, sf)
    h = E.history_channel(g, f, ["ar"], "ts", "binary")
    return h.select("ar", stamp("ts").alias("t"), F.col("hist").cast("double").alias("hist"))


@query("t02_history_skip_ab", f"""WITH {GRID10} SELECT g.ar, strftime(g.ts, '%Y-%m-%d %H:%M:%S') AS t, CAST(coalesce(max(sev) - 2, 0) AS DOUBLE) AS hist
FROM g LEFT JOIN flares f ON f.ar = g.ar AND f.sev >= 3 AND g.ts >= timestamp_start AND g.ts <= timestamp_end GROUP BY 1, 2""")
def _(spark, sf):
    g, f = grid10(spark, sf)
    h = E.history_channel(g, f, ["ar"], "ts", "ordinal", skip_ab=True)
    return h.select("ar", stamp("ts").alias("t"), F.col("hist").cast("double").alias("hist"))


COVER = f"""{HOURLY}, {BACKGROUND}, cv AS (SELECT h.satellite, CAST(h.ts AS DATE) AS date, count(flux) AS ok, count(*) AS n FROM hourly h GROUP BY 1, 2)"""


def cover(spark, sf):
    return hourly(spark, sf).groupBy("satellite", G.day_of("ts").alias("date")).agg(
        F.count("flux").alias("ok"), F.count(F.lit(1)).alias("n"))


@query("f05_coverage", f"""WITH {COVER} SELECT satellite, CAST(date AS VARCHAR) AS day, round(CAST(ok AS DOUBLE) / n, 6) AS present,
  round(ok / 24.0, 6) AS expected FROM cv WHERE CAST(ok AS DOUBLE) / n >= 0.9""")
def _(spark, sf):
    ok, n = F.col("ok"), F.col("n")
    d = cover(spark, sf).withColumns({"present": G.coverage(ok, n),
                                      "expected": G.coverage(ok, n, 24, "expected")})
    return d.where("present >= 0.9").select("satellite", F.col("date").cast("string").alias("day"),
                                            r6("present").alias("present"), r6("expected").alias("expected"))


@query("f06_valid_background", f"""WITH {FLUX}, {BACKGROUND} SELECT satellite, CAST(date AS VARCHAR) AS day, background FROM bgday WHERE background > 150""")
def _(spark, sf):
    bg = G.first_per_day(background(spark, sf), KEY, "ts", "background")
    low = F.when(F.col("background") > 150, F.col("background") - 150).otherwise(F.lit(float("nan")))
    return bg.where(G.valid_background(low)).select(
        "satellite", F.col("date").cast("string").alias("day"), "background")


@query("a01_resample_stream", f"""WITH {FLUX} SELECT satellite, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS t, round(avg(flux), 8) AS flux FROM flux GROUP BY 1, 2""")
def _(spark, sf):
    import uuid

    from flareframe.queries.inputs import table
    from flareframe.session import shared_dir
    from flareframe.streaming.resample import latest_bins, resample_stream, run_bins
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, sf, "events").schema) \
        .option("pathGlobFilter", "events.parquet").parquet(sf)
    live = events.select(F.col("event_type").alias("satellite"), "ts", F.col("value").alias("flux"))

    run_bins(resample_stream(live, KEY, "ts", "flux", "1 hour"), out)
    d = latest_bins(spark, out, [*KEY, "ts"])
    return d.select("satellite", stamp("ts").alias("t"), r6("flux", 8).alias("flux"))


@query("j02_label_ahead_stream", f"""WITH fl AS (SELECT event_id AS id, user_id % 8 AS ar, ts, {SEV_SQL} AS sev FROM events),
w AS (SELECT id, ar, ts FROM fl WHERE id % 10 = 0 AND ts <= (SELECT max(ts) FROM fl) - INTERVAL 2 DAY)
SELECT w.id, strftime(w.ts, '%Y-%m-%d %H:%M:%S') AS t, {sev_to_class_sql('max(e.sev)')} AS flare_class
FROM w LEFT JOIN fl e ON e.ar = w.ar AND e.ts > w.ts + INTERVAL 1 HOUR AND e.ts <= w.ts + INTERVAL 7 HOUR GROUP BY 1, 2""")
def _(spark, sf):
    from flareframe.queries.inputs import EVENT_CLASS, table
    from flareframe.session import folder
    from flareframe.streaming.labels import label_ahead_stream, latest_labels, run_labels
    out, schema = folder(spark, "stream-labels"), table(spark, sf, "events").schema

    def live():
        e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 8).alias("ar"), F.col("ts").alias("t_occ"),
                        L.severity(L.lookup(EVENT_CLASS, F.col("event_type"))).alias("sev"))
    run_labels(label_ahead_stream(live().where("id % 10 = 0"), live(), ["ar"], "id", "t_occ", "6 hours", "1 hour", "10 hours"), out)
    # windows near the end of the stream are still open
    last = table(spark, sf, "events").agg(F.max("ts")).scalar()
    d = latest_labels(spark, out).where(F.col("t_end") <= last - F.expr("INTERVAL '2' DAY"))
    return d.select("id", stamp("t_end").alias("t"), "flare_class")
