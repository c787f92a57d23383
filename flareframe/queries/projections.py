"""Names, times and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from flareframe.functions import labels as L
from flareframe.functions import names as N
from flareframe.queries.inputs import (BACKGROUND, FLUX, FRAMES, ITEMS, background, frames, items,
                                       stamp, table)
from flareframe.queries.registry import query

# raw class texts of every spelling, made from the event rows
RAW_SQL = """raw AS (SELECT event_id AS id, value, CASE event_id % 9 WHEN 0 THEN '0' WHEN 1 THEN 'NONE' WHEN 2 THEN ''
  WHEN 3 THEN 'C' || (event_id % 10) || '.' || (event_id % 7) WHEN 4 THEN 'M ' || (event_id % 10) WHEN 5 THEN '"x1.5"'
  WHEN 6 THEN ' b4.0' WHEN 7 THEN '0.0' ELSE 'A2.1' END AS s FROM events)"""


def raw(spark, sf):
    i = F.col("event_id")
    pick = i % 9
    num = (i % 10).cast("string")
    s = (F.when(pick == 0, "0").when(pick == 1, "NONE").when(pick == 2, "")
         .when(pick == 3, F.concat(F.lit("C"), num, F.lit("."), (i % 7).cast("string")))
         .when(pick == 4, F.concat(F.lit("M "), num)).when(pick == 5, '"x1.5"')
         .when(pick == 6, " b4.0").when(pick == 7, "0.0").otherwise("A2.1"))
    return table(spark, sf, "events").select(i.alias("id"), "value", s.alias("s"))


@query("p01_file_time", f"WITH {ITEMS} SELECT id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS t FROM items")
def _(spark, sf):
    return items(spark, sf).select("id", stamp(N.file_time(F.col("filepath"))).alias("t"))


@query("p02_file_time_any", """SELECT event_id AS id, CASE WHEN event_id % 5 = 4 THEN NULL
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_id") % 5
    fmt = lambda f: F.date_format("ts", f)      # noqa: E731
    name = (F.when(kind == 0, fmt("yyyy-MM-dd_HH-mm-ss")).when(kind == 1, fmt("yyyyMMdd_HHmmss"))
            .when(kind == 2, fmt("yyyy-MM-dd'T'HH:mm:ss")).when(kind == 3, fmt("yyyy-MM-dd HH:mm:ss"))
            .otherwise("undated"))
    path = F.concat(F.lit("d/2024/img_"), name, F.lit(".png"))
    return e.select(F.col("event_id").alias("id"), stamp(N.file_time_any(path)).alias("t"))


@query("p03_file_key", """SELECT event_id AS id, user_id AS ar, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    lead = F.when(F.col("event_id") % 2 == 0, "AR").otherwise("")
    path = F.concat(F.lit("x/"), lead, F.col("user_id").cast("string"), F.lit("_mag_"),
                    F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".fits"))
    k = N.file_key_time(path)
    return e.select(F.col("event_id").alias("id"), k["ar"].alias("ar"), stamp(k["ts"]).alias("t"))


@query("p04_file_stem", f"WITH {ITEMS} SELECT id, ar || '_hmi.M_720s.' || strftime(ts, '%Y%m%d_%H%M%S') || '_TAI' AS sname FROM items")
def _(spark, sf):
    return items(spark, sf).select("id", N.file_stem(F.col("filepath")).alias("sname"))


@query("p05_base_label", f"WITH {RAW_SQL} SELECT id, CASE WHEN substr(s, 1, 1) IN ('C', 'M', 'X') THEN substr(s, 1, 1) ELSE 'NONE' END AS label FROM raw")
def _(spark, sf):
    return raw(spark, sf).select("id", L.base_label(F.col("s")).alias("label"))


@query("p06_class_letter", f"""WITH {RAW_SQL} SELECT id, CASE WHEN upper(substr(ltrim(s), 1, 1)) IN ('A', 'B', 'C', 'M', 'X')
  THEN upper(substr(ltrim(s), 1, 1)) END AS letter FROM raw""")
def _(spark, sf):
    return raw(spark, sf).select("id", L.class_letter(F.col("s")).alias("letter"))


REG_SQL = RAW_SQL + """, reg AS (SELECT id, CASE WHEN s IN ('0', '0.0') THEN '0' WHEN s = '"x1.5"' THEN 'X1.5'
  WHEN s LIKE 'M %' THEN replace(s, ' ', '') ELSE upper(trim(s)) END AS r FROM raw)"""


@query("p07_regression_label", f"WITH {REG_SQL} SELECT id, r FROM reg")
def _(spark, sf):
    return raw(spark, sf).select("id", L.regression_label(F.col("s")).alias("r"))


@query("p08_label_struct", f"""WITH {REG_SQL} SELECT id,
  CASE WHEN substr(r, 1, 1) IN ('C', 'M', 'X') THEN substr(r, 1, 1) ELSE 'NONE' END AS flare_type,
  CAST(CASE substr(r, 1, 1) WHEN 'C' THEN 1 WHEN 'M' THEN 2 WHEN 'X' THEN 3 ELSE 0 END AS BIGINT) AS flare_id,
  CASE WHEN substr(r, 1, 1) IN ('M', 'X') THEN 'M+' ELSE 'NONE' END AS label,
  CAST(CASE WHEN substr(r, 1, 1) IN ('M', 'X') THEN 1 ELSE 0 END AS BIGINT) AS label_id FROM reg""")
def _(spark, sf):
    d = raw(spark, sf).select("id", L.label_struct(F.col("s")).alias("x"))
    return d.select("id", "x.flare_type", F.col("x.flare_id").cast("long").alias("flare_id"),
                    "x.label", F.col("x.id").cast("long").alias("label_id"))


@query("p09_severity", """SELECT event_id AS id, CAST(CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4
  WHEN 'signup' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS BIGINT) AS sev FROM events""")
def _(spark, sf):
    return items(spark, sf).select("id", L.severity(F.col("flare_type")).cast("long").alias("sev"))


@query("p10_fold_ab", """SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'X' WHEN 'purchase' THEN 'M'
  WHEN 'signup' THEN 'C' ELSE 'NONE' END AS label FROM events""")
def _(spark, sf):
    return items(spark, sf).select("id", L.fold_ab(F.col("flare_type")).alias("label"))


@query("p11_relabel", f"""WITH {ITEMS} SELECT id, CASE WHEN label = 'NONE' THEN 'NONE' ELSE 'C+' END AS label_c,
  CASE WHEN label IN ('M', 'X') THEN 'M+' ELSE 'NONE' END AS label_m, CAST(CASE WHEN label = 'NONE' THEN 0 ELSE 1 END AS BIGINT) AS id_c,
  CAST(CASE WHEN label IN ('M', 'X') THEN 1 ELSE 0 END AS BIGINT) AS id_m, CAST(flare_id AS BIGINT) AS flare_id, label AS flare_type FROM items""")
def _(spark, sf):
    from flareframe.plans.datasets import relabel
    i = items(spark, sf).select("id", F.col("label").alias("flare_type"))
    c = relabel(i, "binary", "C", "flare_type", id_name="id_c", label_name="label_c")
    m = relabel(c, "binary", "M", "flare_type", id_name="id_m", label_name="label_m")
    return m.select("id", "label_c", "label_m", F.col("id_c").cast("long"), F.col("id_m").cast("long"),
                    F.col("flare_id").cast("long"), "flare_type")


@query("p12_label_maps", f"""WITH {ITEMS} SELECT id, CAST(flare_id AS BIGINT) AS target4,
  CAST(CASE WHEN flare_id >= 1 THEN 1 ELSE 0 END AS BIGINT) AS target_c,
  CAST(CASE WHEN flare_id >= 2 THEN 1 ELSE 0 END AS BIGINT) AS target_m FROM items""")
def _(spark, sf):
    t = {n: L.label_maps(*a)["target"] for n, a in {
        "target4": ("multi",), "target_c": ("binary", "C"), "target_m": ("binary", "M")}.items()}
    return items(spark, sf).select("id", *[L.lookup(m, F.col("flare_id")).cast("long").alias(n)
                                           for n, m in t.items()])


@query("p13_collapse", f"""WITH {RAW_SQL} SELECT id, CASE WHEN upper(s) LIKE '%NONE%' THEN 'NONE'
  WHEN upper(ltrim(s)) LIKE 'M%' OR upper(ltrim(s)) LIKE 'X%' OR upper(s) LIKE '%M+%' OR upper(s) LIKE '%X+%' THEN 'M+' ELSE 'OTHER' END AS bucket FROM raw""")
def _(spark, sf):
    return raw(spark, sf).select("id", L.collapse(F.col("s")).alias("bucket"))


@query("p14_ordinal_flags", f"""WITH {ITEMS} SELECT id, CAST(flare_id >= 1 AS BIGINT) AS ge1, CAST(flare_id >= 2 AS BIGINT) AS ge2,
  CAST(flare_id >= 3 AS BIGINT) AS ge3 FROM items""")
def _(spark, sf):
    f = L.ordinal_flags(F.col("flare_id"), 4)
    return items(spark, sf).select("id", *[f[i].cast("long").alias(f"ge{i + 1}") for i in range(3)])


@query("p15_one_hot", f"""WITH {FRAMES}, h AS (SELECT ar, ts, CAST(CASE label WHEN 'X' THEN 3 WHEN 'M' THEN 2 WHEN 'C' THEN 1 ELSE 0 END AS BIGINT) AS y,
  CAST(ar % 4 AS BIGINT) AS y2 FROM frames)
SELECT ar, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, j, CAST(y = j AS BIGINT) AS h0, CAST(y2 = j AS BIGINT) AS h1
FROM h, (SELECT unnest([0, 1, 2, 3]) AS j) k""")
def _(spark, sf):
    y = L.lookup(L.LABEL_ID, F.col("label"))
    d = frames(spark, sf).select("ar", stamp("ts").alias("t"), L.one_hot_each(
        F.array(y, (F.col("ar") % 4).cast("int")), 4).alias("hh"), L.one_hot(y, 4).alias("h"))
    return d.select("ar", "t", F.posexplode("h").alias("j", "h0"), "hh").select(
        "ar", "t", "j", F.col("h0").cast("long").alias("h0"),
        F.get(F.get("hh", F.lit(1)), F.col("j")).cast("long").alias("h1"))


@query("p16_group_key", """SELECT event_id AS id, CASE WHEN user_id % 10 <> 0 THEN CAST(user_id AS VARCHAR)
  ELSE 'AR_MISSING::' || event_id END AS ar_key FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    ar = F.when(F.col("user_id") % 10 != 0, F.col("user_id"))
    return e.select(F.col("event_id").alias("id"), N.group_key(ar, F.col("event_id")).alias("ar_key"))


@query("p17_safe_name", "SELECT p_partkey AS id, regexp_replace(p_name || '+' || p_type, '[^A-Za-z0-9_]+', '_', 'g') AS name FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"),
                    N.safe_name(F.concat("p_name", F.lit("+"), "p_type")).alias("name"))


@query("p18_window_metadata", f"""WITH {FLUX}, {BACKGROUND},
w AS (SELECT satellite, CAST(date AS TIMESTAMP) AS s FROM bgday)
SELECT satellite, CAST(epoch(s) AS DOUBLE) AS t_start, CAST(epoch(s) + 86400 AS DOUBLE) AS t_end,
  strftime(s, '%Y-%m-%d %H:%M:%S') AS date_start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS date_end, CAST(3600 AS DOUBLE) AS dt,
  strftime(s + INTERVAL 26 HOUR, '%Y-%m-%d %H:%M:%S') AS date_forecast_start,
  strftime(s + INTERVAL 50 HOUR, '%Y-%m-%d %H:%M:%S') AS date_forecast_end,
  CAST(epoch(s) + 26 * 3600 AS DOUBLE) AS t_forecast_start, CAST(epoch(s) + 50 * 3600 AS DOUBLE) AS t_forecast_end FROM w""")
def _(spark, sf):
    from flareframe.operators.grid import day_windows, first_per_day
    from flareframe.plans.flux_windows import window_metadata
    bg = first_per_day(background(spark, sf), ["satellite"], "ts", "background")
    w = day_windows(bg, ["satellite"], "ts", "24 hours")
    return window_metadata(w, "1 hour", "24 hours", "2 hours").select(
        "satellite", "t_start", "t_end", "date_start", "date_end", "dt", "date_forecast_start",
        "date_forecast_end", "t_forecast_start", "t_forecast_end")


@query("p19_paths", f"""WITH {ITEMS} SELECT id, '/root/img/' || filepath AS full_path,
  ar || '_hmi.M_720s.' || strftime(ts, '%Y%m%d_%H%M%S') || '_TAI.png' AS base FROM items""")
def _(spark, sf):
    p = F.col("filepath")
    return items(spark, sf).select("id", N.join_path("/root/img/", p).alias("full_path"),
                                   N.base_names(F.array(p))[0].alias("base"))


@query("p20_select_features", "SELECT l_orderkey, l_linenumber, l_quantity AS feat1, l_discount AS feat3, l_tax AS feat4 FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    names = {"feat1": "l_quantity", "feat2": "l_extendedprice", "feat3": "l_discount", "feat4": "l_tax"}
    d = li.select("l_orderkey", "l_linenumber", *[F.col(c).alias(f) for f, c in names.items()])
    return d.select("l_orderkey", "l_linenumber", *N.select_features("0,feat3,4", n=4))


@query("p21_agreement_letter", f"""WITH {RAW_SQL} SELECT id, CASE WHEN upper(substr(trim(s), 1, 1)) IN ('C', 'M', 'X') THEN upper(substr(trim(s), 1, 1))
  WHEN upper(substr(trim(s), 1, 1)) IN ('N', 'A', 'B', '0') THEN 'NONE' END AS letter FROM raw""")
def _(spark, sf):
    return raw(spark, sf).select("id", L.agreement_letter(F.col("s")).alias("letter"))


@query("p22_series_times", """WITH s AS (SELECT o_orderkey AS id, o_orderdate AS t0, CAST(o_orderkey % 4 AS BIGINT) AS n FROM orders)
SELECT id, CAST(k AS BIGINT) AS pos, strftime(t0 + to_minutes(12 * k), '%Y-%m-%d %H:%M:%S') AS t FROM s, (SELECT unnest([0, 1, 2]) AS k) q WHERE k < n""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    t = N.series_times(F.col("o_orderdate"), F.col("o_orderkey") % 4, "12 minutes")
    return o.select(F.col("o_orderkey").alias("id"), F.posexplode(t).alias("pos", "t")) \
        .select("id", F.col("pos").cast("long").alias("pos"), stamp("t").alias("t"))


# F: filters
@query("f01_allow_list", f"""WITH {ITEMS} SELECT id, ar FROM items WHERE ar IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(spark, sf):
    allow = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'") \
        .select(F.col("c_custkey").alias("ar"))
    return items(spark, sf).join(allow, "ar", "left_semi").select("id", "ar")


@query("f02_known_labels", """SELECT o_orderkey AS id, substr(o_orderpriority, 3, 1) AS label FROM orders WHERE substr(o_orderpriority, 3, 1) IN ('M', 'H')""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"),
                                          F.substring("o_orderpriority", 3, 1).alias("label"))
    return o.where(F.col("label").isin("M", "H"))


@query("f03_skip_years", "SELECT o_orderkey AS id FROM orders WHERE year(o_orderdate) NOT IN (1995, 1997)")
def _(spark, sf):
    from flareframe.operators.grid import skip_years
    return skip_years(table(spark, sf, "orders"), "o_orderdate", [1995, 1997]) \
        .select(F.col("o_orderkey").alias("id"))


@query("f04_skip_ranges", """SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1994-03-01' AND o_orderdate < TIMESTAMP '1994-07-01')
  AND NOT (o_orderdate >= TIMESTAMP '1996-12-01' AND o_orderdate < TIMESTAMP '1997-02-01')""")
def _(spark, sf):
    from flareframe.operators.grid import skip_ranges
    return skip_ranges(table(spark, sf, "orders"), "o_orderdate", ["1994-03:1994-06", "1996-12:1997-01"]) \
        .select(F.col("o_orderkey").alias("id"))


@query("f08_require_groups", f"WITH {ITEMS} SELECT count(*) AS n, count(CASE WHEN id % 7 = 0 THEN 1 END) AS n_refused FROM items")
def _(spark, sf):
    from flareframe.operators.splits import require_groups
    d = items(spark, sf).withColumn("ar", F.when(F.col("id") % 7 != 0, F.col("ar")))
    try:
        require_groups(d, "ar")
        refused = 0
    except ValueError as e:
        refused = int(str(e).split()[0])                      # the items without a group that it names
    return require_groups(d, "ar", allow_missing=True).agg(F.count(F.lit(1)).alias("n"), F.lit(refused).cast("long").alias("n_refused"))


@query("f11_same_length", "SELECT vec_id AS id FROM embeddings WHERE len(embedding) = 64 AND vec_id % 3 <> 0 AND vec_id % 5 <> 0")
def _(spark, sf):
    from flareframe.operators.series import same_length
    x, i = F.col("embedding"), F.col("vec_id")
    d = table(spark, sf, "embeddings").select(i.alias("id"), F.when(i % 3 == 0, F.slice(x, 1, 60)).otherwise(x).alias("a"),
                                              F.when(i % 5 != 0, x).alias("b"))
    return same_length(d, ["a", "b"], 64).select("id")


@query("f13_drop_null", f"""WITH {ITEMS} SELECT id, value FROM items WHERE value < 100""")
def _(spark, sf):
    i = items(spark, sf).select("id", F.when(F.col("value") < 100, F.col("value")).alias("value"))
    return i.dropna(subset=["value"])


@query("f14_valid_events", f"""WITH {RAW_SQL} SELECT id FROM raw WHERE upper(substr(ltrim(s), 1, 1)) IN ('A', 'B', 'C', 'M', 'X')""")
def _(spark, sf):
    d = raw(spark, sf).withColumn("class", L.class_letter(F.col("s")))
    return d.where(F.col("class").isin(*L.CLASSES)).select("id")


