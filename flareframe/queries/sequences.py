"""Per-entity sequences."""

from __future__ import annotations

from pyspark.sql import functions as F


from flareframe.operators import sequences as Q
from flareframe.operators.grid import columns_to_arrays
from flareframe.queries.inputs import (FRAMES, ITEMS, class_to_sev_sql, flux, frames, items,
                                       r6, sev_to_class_sql, stamp, table)
from flareframe.queries.registry import query

T = "'%Y-%m-%d %H:%M:%S'"
W = "WINDOW w AS (PARTITION BY ar ORDER BY ts)"


@query("w01_cadence_report", f"""WITH {FRAMES}, p AS (SELECT ar, ts, file, lag(ts) OVER w AS prev_ts FROM frames {W})
SELECT ar, strftime(ts, {T}) AS t, strftime(prev_ts, {T}) AS prev_t, file, CAST(date_diff('minute', prev_ts, ts) AS DOUBLE) AS gap_min
FROM p WHERE date_diff('minute', prev_ts, ts) <> 60""")
def _(spark, sf):
    d = Q.cadence_report(frames(spark, sf), ["ar"], "ts", "1 hour")
    return d.select("ar", stamp("ts").alias("t"), stamp("prev_ts").alias("prev_t"), "file", "gap_min")


@query("w02_unsorted", """WITH p AS (SELECT o_custkey AS ar, o_orderkey AS id, o_orderdate AS ts, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev_ts FROM orders)
SELECT ar, id, strftime(ts, '%Y-%m-%d') AS d, strftime(prev_ts, '%Y-%m-%d') AS prev_d FROM p WHERE ts <= prev_ts""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("ar"), F.col("o_orderkey").alias("id"),
                                          F.col("o_orderdate").alias("ts"))
    d = Q.unsorted(o, ["ar"], "ts", "id")
    return d.select("ar", "id", F.date_format("ts", "yyyy-MM-dd").alias("d"),
                    F.date_format("prev_ts", "yyyy-MM-dd").alias("prev_d"))


ISLANDS = FRAMES + """, b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY ar ORDER BY ts) = INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk FROM frames),
i0 AS (SELECT *, sum(brk) OVER (PARTITION BY ar ORDER BY ts) - 1 AS island FROM b),
isl AS (SELECT ar, ts, label, v, file, CAST(island AS BIGINT) AS island, row_number() OVER (PARTITION BY ar, island ORDER BY ts) - 1 AS pos FROM i0)"""


@query("w03_islands", f"WITH {ISLANDS} SELECT ar, strftime(ts, {T}) AS t, island, pos FROM isl")
def _(spark, sf):
    d = Q.islands(frames(spark, sf), ["ar"], "ts", "1 hour", block=128)
    return d.select("ar", stamp("ts").alias("t"), "island", "pos")


@query("w04_fixed_series", f"""WITH {ISLANDS},
st AS (SELECT a.ar, a.island, a.pos AS start_pos FROM isl a WHERE a.pos % 3 = 0
  AND EXISTS (SELECT 1 FROM isl z WHERE z.ar = a.ar AND z.island = a.island AND z.pos = a.pos + 6)),
m AS (SELECT st.ar, st.island, st.start_pos, i.ts, i.v, i.label, (i.pos - st.start_pos) / 2 AS k FROM st JOIN isl i
  ON i.ar = st.ar AND i.island = st.island AND i.pos IN (start_pos, start_pos + 2, start_pos + 4, start_pos + 6))
SELECT ar, island, start_pos, count(*) AS npoints, strftime(min(ts), {T}) AS t_start, strftime(max(ts), {T}) AS t_end,
  round(sum(v * (k + 1)), 4) AS checksum, arg_max(label, ts) AS label FROM m GROUP BY 1, 2, 3""")
def _(spark, sf):
    d = Q.fixed_series(frames(spark, sf), ["ar"], "ts", ["v"], n=4, step=2, stride=3, every="1 hour",
                       label="label")
    check = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return d.select("ar", "island", "start_pos", "npoints", stamp("t_start").alias("t_start"),
                    stamp("t_end").alias("t_end"), r6(check, 4).alias("checksum"), "label")


@query("a08_series_points", f"""WITH {ISLANDS},
st AS (SELECT ar, island, pos AS start_pos FROM isl a WHERE pos % 5 = 0
  AND EXISTS (SELECT 1 FROM isl z WHERE z.ar = a.ar AND z.island = a.island AND z.pos = a.pos + 4))
SELECT st.ar, st.island, start_pos, i.pos - start_pos AS k, i.v FROM st JOIN isl i ON i.ar = st.ar AND i.island = st.island
  AND i.pos BETWEEN start_pos AND start_pos + 4""")
def _(spark, sf):
    d = Q.fixed_series(frames(spark, sf), ["ar"], "ts", ["v"], n=5, every="1 hour")
    return d.select("ar", "island", "start_pos", F.posexplode("v").alias("k", "v")) \
        .withColumn("k", F.col("k").cast("long"))


CLIPS = FRAMES + """, cl AS (SELECT ar, ts, file, label, lead(ts, 2) OVER w AS t1, lead(ts, 4) OVER w AS t2, lead(file, 2) OVER w AS f1,
  lead(file, 4) OVER w AS f2, lead(label, 4) OVER w AS lab FROM frames WINDOW w AS (PARTITION BY ar ORDER BY ts)),
clips AS (SELECT ar, ts AS t_start, t2 AS t_end, file AS f0, f1, f2, lab AS label FROM cl
  WHERE t1 - ts = INTERVAL 2 HOUR AND t2 - t1 = INTERVAL 2 HOUR)"""


def clips(spark, sf):
    return Q.clips(frames(spark, sf), ["ar"], "ts", "file", "label", 3, "2 hours", "1 hour")


@query("w05_clips", f"""WITH {CLIPS} SELECT ar, strftime(t_start, {T}) AS t_start, strftime(t_end, {T}) AS t_end, f0 || '|' || f1 || '|' || f2 AS files, label FROM clips""")
def _(spark, sf):
    return clips(spark, sf).select("ar", stamp("t_start").alias("t_start"), stamp("t_end").alias("t_end"),
                                   F.array_join("filepaths", "|").alias("files"), "label")


@query("w06_labels_at_steps", f"""WITH {FRAMES} SELECT ar, strftime(ts, {T}) AS t, coalesce(lead(label, 1) OVER w, 'NONE') AS l1,
  coalesce(lead(label, 6) OVER w, 'NONE') AS l6, coalesce(lead(label, 24) OVER w, 'NONE') AS l24 FROM frames {W}""")
def _(spark, sf):
    d = Q.labels_at_steps(frames(spark, sf), ["ar"], "ts", "label", [1, 6, 24])
    return d.select("ar", stamp("ts").alias("t"), *[
        F.get("labels", F.lit(i)).alias(f"l{k}") for i, k in enumerate((1, 6, 24))])


@query("w07_max_label_within", f"""WITH {FRAMES}, s AS (SELECT ar, ts, {class_to_sev_sql('label')} AS sev FROM frames)
SELECT ar, strftime(ts, {T}) AS t, {sev_to_class_sql('max(sev) OVER (PARTITION BY ar ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)')} AS label_2,
  {sev_to_class_sql('max(sev) OVER (PARTITION BY ar ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)')} AS label_4 FROM s""")
def _(spark, sf):
    d = Q.max_label_within(frames(spark, sf), ["ar"], "ts", "label", {"label_2": 2, "label_4": 4})
    return d.select("ar", stamp("ts").alias("t"), "label_2", "label_4")


@query("w07_clip_labels", f"""WITH {FRAMES}, s AS (SELECT ar, ts, {class_to_sev_sql('label')} AS sev, row_number() OVER w AS rn, lead(ts, 4) OVER w AS t4,
  count(*) OVER (PARTITION BY ar) AS n FROM frames {W})
SELECT a.ar, strftime(a.ts, {T}) AS t, CAST(1 + (CASE WHEN a.rn + 2 <= n THEN 1 ELSE 0 END) + (CASE WHEN a.rn + 4 <= n THEN 1 ELSE 0 END) AS BIGINT) AS n_frames,
  {sev_to_class_sql('(SELECT max(b.sev) FROM s b WHERE b.ar = a.ar AND b.rn > a.last_rn AND b.rn <= a.last_rn + 3)')} AS label_3
FROM (SELECT *, CASE WHEN rn + 4 <= n THEN rn + 4 WHEN rn + 2 <= n THEN rn + 2 ELSE rn END AS last_rn FROM s) a""")
def _(spark, sf):
    d = Q.clip_labels_ahead(frames(spark, sf), ["ar"], "ts", "label", "file", 3, 2, {"label_3": 3},
                            skip_incomplete=False)
    return d.select("ar", stamp("ts").alias("t"), F.size("filepaths").cast("long").alias("n_frames"), "label_3")


@query("w11_clip_integrity", f"""WITH {FRAMES}, cl AS (SELECT ar, ts, lead(ts, 1) OVER w AS t1, lead(ts, 2) OVER w AS t2 FROM frames {W})
SELECT ar, strftime(ts, {T}) AS t, CAST(t1 - ts <> INTERVAL 1 HOUR AS BIGINT) + CAST(t2 - t1 <> INTERVAL 1 HOUR AS BIGINT) AS n_bad,
  t1 - ts = INTERVAL 1 HOUR AND t2 - t1 = INTERVAL 1 HOUR AS ok FROM cl WHERE t2 IS NOT NULL""")
def _(spark, sf):
    from flareframe.operators.ordered import block_window, home, with_context
    d = with_context(Q.positions(frames(spark, sf), ["ar"], "ts"), after=2)
    w = block_window(["ar"])
    d = home(d.withColumn("filepaths", F.array(*[F.lead("file", k).over(w) for k in range(3)])))
    d = d.where(F.get("filepaths", F.lit(2)).isNotNull())
    d = Q.clip_integrity(d, "filepaths", "1 hour")
    return d.select("ar", stamp("ts").alias("t"), F.size("bad_positions").cast("long").alias("n_bad"), "ok")


@query("w12_last_per_key", f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY ts DESC, id DESC) AS k FROM items) SELECT ar, id, label FROM r WHERE k = 1")
def _(spark, sf):
    return Q.last_per_key(items(spark, sf), ["ar"], "ts", ["id"]).select("ar", "id", "label")


@query("w13_positions", f"WITH {ITEMS} SELECT ar, id, row_number() OVER (PARTITION BY ar ORDER BY ts, id) AS rn FROM items")
def _(spark, sf):
    return Q.positions(items(spark, sf), ["ar"], "ts", ["id"]).select("ar", "id", "rn")


@query("j06_label_at_offset", f"""WITH {FRAMES}
SELECT a.ar, strftime(a.ts, {T}) AS t, b.label AS future_label, b.file AS filepath_future,
  (SELECT count(DISTINCT c.label) FROM frames c WHERE c.ar = a.ar AND c.ts > a.ts AND c.ts <= a.ts + INTERVAL 5 HOUR) AS n_labels
FROM frames a JOIN frames b ON a.ar = b.ar AND b.ts = a.ts + INTERVAL 5 HOUR""")
def _(spark, sf):
    d = Q.label_at_offset(frames(spark, sf), ["ar"], "ts", "label", "5 hours", "file")
    return d.select("ar", stamp("ts").alias("t"), "future_label", "filepath_future", "n_labels")


@query("j12_label_lookup", f"WITH {FRAMES} SELECT i.event_id AS id, f.label FROM events i JOIN frames f ON f.ar = i.user_id % 8 AND f.ts = date_trunc('hour', i.ts)")
def _(spark, sf):
    from flareframe.operators.grid import bin_start
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 8).alias("ar"),
                                          bin_start("ts", "1 hour").alias("ts"))
    return e.join(frames(spark, sf).select("ar", "ts", "label"), ["ar", "ts"]).select("id", "label")


@query("f12_select_items", f"""WITH {ITEMS}, x AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY ts, id) AS rn FROM items WHERE label IN ('M', 'X') AND ar IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89))
SELECT ar, id, label FROM x WHERE rn IN (1, 3, 5)""")
def _(spark, sf):
    d = Q.select_items(items(spark, sf), ["ar"], "ts", ["M", "X"], [1, 2, 3, 5, 8, 13, 21, 34, 55, 89], [1, 3, 5], ["id"])
    return d.select("ar", "id", "label")


@query("f15_regular_cadence", f"""WITH {FRAMES}, cl AS (SELECT ar, ts, lead(ts, 1) OVER w AS t1, lead(ts, 2) OVER w AS t2 FROM frames {W})
SELECT ar, strftime(ts, {T}) AS t FROM cl WHERE t1 - ts = INTERVAL 1 HOUR AND t2 - t1 = INTERVAL 1 HOUR""")
def _(spark, sf):
    d = Q.clips(frames(spark, sf), ["ar"], "ts", "file", "label", 3, "1 hour", "1 hour")
    return d.select("ar", stamp("t_start").alias("t"))


@query("s11_columns_to_arrays", """WITH e AS (SELECT event_type AS satellite, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, CASE WHEN value < 200 THEN value ELSE 'nan'::DOUBLE END) - 1 AS i FROM events)
SELECT satellite, i // 700 AS part, i % 700 AS pos, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t, CASE WHEN value < 200 THEN value END AS flux FROM e""")
def _(spark, sf):
    f = flux(spark, sf).withColumn("flux", F.when(F.col("flux") < 200, F.col("flux"))
                                   .otherwise(F.lit(float("nan"))))
    d = columns_to_arrays(f, ["satellite"], "ts", ["flux"], 700)
    return d.select("satellite", "part", F.posexplode(F.arrays_zip("ts", "flux")).alias("pos", "z")).select(
        "satellite", "part", F.col("pos").cast("long").alias("pos"), F.col("z.ts").alias("t"), F.col("z.flux").alias("flux"))
