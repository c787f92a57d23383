"""Every source and sink, written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flareframe.operators import curves as C
from flareframe.operators import grid as G
from flareframe.operators import series as V
from flareframe.operators import splits as S
from flareframe.plans.datasets import image_items
from flareframe.queries.inputs import (BACKGROUND, FLARES, FLUX, FRAMES, GROUPED, ITEMS, ORDERS, background, flare_events, flux,
                                       frames, items, orders_items, r6, stamp, table)
from flareframe.queries.metrics import CROUND, RUNC, rnd, run_curves
from flareframe.queries.plans import AUG, WIN, augmented, labelled
from flareframe.queries.registry import query
from flareframe.queries.sequences import CLIPS, T, clips
from flareframe.queries.series import MED, vecs
from flareframe.queries.sets import grouped
from flareframe.session import shared_dir
from flareframe.sources import readers as R
from flareframe.sources import writers as W


def fresh(spark, name: str) -> str:
    """A new folder in the shared directory for one write-and-read round."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_read_datalist", f"WITH {ITEMS} SELECT id, ar, label FROM items")
def _(spark, sf):
    d = items(spark, sf)
    # one envelope per entity and hour: every file holds one small JSON document
    env = d.groupBy((F.col("ar") % 4).alias("e"), G.bin_start("ts", "12 hours").alias("d")).agg(F.to_json(F.struct(
        F.collect_list(F.struct("id", "ar", "label")).alias("data"))).alias("value"))
    path = fresh(spark, "datalist")
    env.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return R.read_datalist(spark, path, schema="id long, ar long, label string")


@query("s02_write_dataset", f"WITH {ORDERS} SELECT id, ar, label, split FROM oi")
def _(spark, sf):
    path, d = fresh(spark, "dataset"), orders_items(spark, sf).select("id", "ar", "label", "split")
    W.write_dataset(d, path, ["split"])
    return R.read_dataset(spark, path, d.schema)


@query("s03_read_any", f"WITH {ITEMS} SELECT id, ar, label, value FROM items")
def _(spark, sf):
    path = fresh(spark, "items") + ".csv"
    W.write_csv(items(spark, sf).select("id", "ar", "label", "value"), path)
    return R.read_any(spark, path, schema="id long, ar long, label string, value double")


@query("s04_list_images", f"""WITH {ITEMS}, k AS (SELECT DISTINCT ar % 50 AS ar, label FROM items)
SELECT CAST(ar AS VARCHAR) AS sname, count(*) AS n_files, string_agg(label, ',' ORDER BY label) AS labels FROM k GROUP BY 1""")
def _(spark, sf):
    path = fresh(spark, "images")
    d = items(spark, sf).select((F.col("ar") % 50).alias("ar"), "label", F.lit("x").alias("x"))
    # every (entity, label) is one file: its rows are brought to one task, of which any writes
    d.dropDuplicates(["ar", "label"]).repartition("ar", "label").write.partitionBy("ar", "label").text(path)
    found = R.list_images(spark, path, "*.txt", F.regexp_extract("path", r"ar=(\d+)", 1))
    label = F.transform("filepaths", lambda p: F.regexp_extract(p, "label=([^/]+)", 1))
    return found.select("sname", F.size("filepaths").cast("long").alias("n_files"), F.array_join(label, ",").alias("labels"))


@query("s05_read_labels", f"WITH {FRAMES} SELECT file AS ImgName, label AS Label FROM frames")
def _(spark, sf):
    path = fresh(spark, "labels")
    lines = F.concat(F.lit("# ImgName,Label\n"), F.col("file"), F.lit(",X9.9\n"), F.col("file"), F.lit(","), F.col("label"))
    frames(spark, sf).select(lines).write.text(path)
    return R.read_labels(spark, path)


@query("s06_read_keys", "SELECT CAST(c_custkey AS VARCHAR) AS ar FROM customer")
def _(spark, sf):
    path = fresh(spark, "keys")
    table(spark, sf, "customer").select(F.concat(F.lit("# key\n  "), F.col("c_custkey").cast("string"), F.lit(" \n"))) \
        .write.text(path)
    return R.read_keys(spark, path)


@query("s07_read_feature_rows", f"""SELECT event_id AS id, user_id AS ar, strftime(ts, {T}) AS t, CAST(CASE WHEN event_id % 3 <> 0 THEN event_id % 4 END AS BIGINT) AS class_label,
  CASE WHEN event_id % 2 = 0 THEN 'C1.2' ELSE '0' END AS reg_label, round(value * 29 + 28 * 29 / 2, 4) AS total FROM events""")
def _(spark, sf):
    path = fresh(spark, "features")
    e = table(spark, sf, "events")
    feats = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(28)), lambda i: (F.col("value") + i).cast("string")), ", ")
    line = F.concat_ws(",", F.lit("extra"), feats,
                       F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 4).cast("string")).otherwise("?"),
                       F.when(F.col("event_id") % 2 == 0, '"c 1.2"').otherwise("0.0"),
                       F.concat(F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd_HHmmss"),
                                F.lit("_"), F.col("event_id").cast("string"), F.lit(".fits")))
    e.select(line).write.text(path)
    d = R.read_feature_rows(spark, path).where("error IS NULL")
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return d.select(F.regexp_extract("fname", r"_(\d+)\.fits$", 1).cast("long").alias("id"), "ar", stamp("ts").alias("t"),
                    F.col("class_label").cast("long").alias("class_label"), "reg_label", r6(total, 4).alias("total"))


@query("s09_read_series", f"WITH {FLUX} SELECT satellite, strftime(ts, {T}) AS t, CASE WHEN flux <= 200 THEN flux END AS flux FROM flux")
def _(spark, sf):
    path = fresh(spark, "flux")
    v = F.when(F.col("flux") > 200, F.lit(float("nan"))).otherwise(F.col("flux"))
    flux(spark, sf).select("satellite", F.col("ts").alias("Time"), v.alias("XRSB_flux_obs")).write.partitionBy("satellite").parquet(path)
    d = R.read_series(spark, path, ["time", "timestamp"], ["xrsb_flux"], "xrsb")
    sat = F.regexp_extract(F.input_file_name(), r"satellite=([^/]+)", 1)
    return d.select(sat.alias("satellite"), stamp("ts").alias("t"), "flux")


MIXED_EVENTS = {0: ["start_time", "timestamp_end", "class"], 1: ["flare_type", "TIMESTAMP_END", "note", "Timestamp_Start"],
                2: ["CLASS", "Timestamp", "timestamp_END"]}


@query("s08_mixed_columns", f"""WITH {FLARES} SELECT id % 3 AS layout, strftime(timestamp_start, {T}) AS t_occ, class, CAST(sev AS BIGINT) AS sev,
  CASE WHEN id % 3 <> 2 THEN strftime(timestamp_start, {T}) END AS t_start, CASE WHEN id % 5 <> 0 THEN strftime(timestamp_end, {T}) END AS t_end
FROM flares WHERE id % 7 <> 0""")
def _(spark, sf):
    path = fresh(spark, "mixed-events")
    role = {"start_time": "s", "timestamp_start": "s", "timestamp": "s", "timestamp_end": "e", "class": "c", "flare_type": "c", "note": "k"}
    d = flare_events(spark, sf).select(
        "id", stamp("timestamp_start").alias("s"), F.when(F.col("id") % 5 != 0, stamp("timestamp_end")).alias("e"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lower("class"), F.lit("1."), (F.col("id") % 3).cast("string"))).alias("c"), F.lit("M9").alias("k"))
    for i, names in MIXED_EVENTS.items():
        d.where(F.col("id") % 3 == i).select(*[F.col(role[n.lower()]).alias(n) for n in names]).write.option("header", True).csv(f"{path}/{i}")
    got = R.read_events(spark, path)
    return got.select(F.substring("flare_type", -1, 1).cast("long").alias("layout"), stamp("t_occ").alias("t_occ"), "class",
                      F.col("sev").cast("long").alias("sev"), stamp("timestamp_start").alias("t_start"), stamp("timestamp_end").alias("t_end"))


@query("s09_mixed_columns", f"WITH {FLUX} SELECT satellite, strftime(ts, {T}) AS t, CASE WHEN flux <= 200 THEN flux END AS flux FROM flux")
def _(spark, sf):
    path = fresh(spark, "mixed-flux")
    v = F.when(F.col("flux") > 200, F.lit(float("nan"))).otherwise(F.col("flux"))
    layouts = [[F.col("ts").alias("Time"), v.alias("XRSB_flux_obs")], [v.cast("string").alias("xrsb_flux"), F.lit(7.5).alias("XRSB_flux_obs"), F.col("ts").alias("timestamp")],
               [F.lit(True).alias("quality"), v.alias("goes_xrsb_mean"), F.col("ts").cast("timestamp").alias("TIMESTAMP")]]
    f = flux(spark, sf).withColumn("third", F.pmod(F.xxhash64("satellite", "ts"), F.lit(3)))
    for i, cols in enumerate(layouts):
        f.where(F.col("third") == i).select("satellite", *cols).write.parquet(f"{path}/{i}")
    d = R.read_series(spark, path, ["time", "timestamp"], ["xrsb_flux"], "xrsb")
    return d.select("satellite", stamp("ts").alias("t"), "flux")


@query("s10_mixed_columns", f"WITH {FLUX}, {BACKGROUND} SELECT satellite, CAST(date AS VARCHAR) AS day, background FROM bgday")
def _(spark, sf):
    path = fresh(spark, "mixed-background")
    b = background(spark, sf).withColumn("half", F.pmod(F.xxhash64("satellite", "ts"), F.lit(2)))
    b.where("half = 0").select("satellite", F.col("ts").alias("time"), F.col("background").alias("bkg_long")).write.parquet(f"{path}/a")
    b.where("half = 1").select(F.col("background"), F.lit(0.0).alias("bkg"), "satellite", F.col("ts").alias("timestamp")).write.parquet(f"{path}/b")
    d = R.read_series(spark, path, ["time", "timestamp"], ["background_long", "background", "bkg_long", "bkg"], name="background")
    d = G.first_per_day(d, ["satellite"], "ts", "background")
    return d.select("satellite", F.col("date").cast("string").alias("day"), "background")


@query("s10_read_background", f"WITH {FLUX}, {BACKGROUND} SELECT satellite, CAST(date AS VARCHAR) AS day, background FROM bgday")
def _(spark, sf):
    path = fresh(spark, "background")
    background(spark, sf).withColumnsRenamed({"ts": "timestamp", "background": "bkg"}).write.parquet(path)
    d = R.read_series(spark, path, ["time", "timestamp"], ["background", "bkg"], name="background")
    d = G.first_per_day(d, ["satellite"], "ts", "background")
    return d.select("satellite", F.col("date").cast("string").alias("day"), "background")


@query("s12_read_curves", f"WITH {RUNC} SELECT CAST(run AS VARCHAR) AS run, round(threshold, 6) AS threshold, {CROUND} FROM cv")
def _(spark, sf):
    path = fresh(spark, "curves")
    W.write_curves(run_curves(spark, sf), path, "run")
    d = R.read_curves(spark, path)
    d = d.withColumn("run", F.regexp_extract("run", r"run=(\d+)", 1))
    return rnd(d.select("run", "threshold", *C.CURVE), ["threshold", *C.CURVE])


@query("s13_write_curves", f"WITH {RUNC} SELECT round(threshold, 6) AS threshold, {CROUND} FROM cv")
def _(spark, sf):
    path = fresh(spark, "curve")
    W.write_curves(run_curves(spark, sf), path)
    return rnd(R.read_csv(spark, path, R.CURVE_SCHEMA).select("threshold", *C.CURVE), ["threshold", *C.CURVE])


@query("s14_write_flat_windows", f"""WITH {WIN}, f AS (SELECT satellite, s FROM fw WHERE reason = 'ok' AND n_points = 24)
SELECT strftime(s, {T}) AS t0, round(sum(CAST(ratio AS DOUBLE)), 3) AS total FROM ra JOIN f USING (satellite, s) GROUP BY satellite, s""")
def _(spark, sf):
    from flareframe.plans.flux_windows import flatten_windows
    path = fresh(spark, "flat")
    W.write_flat_windows(flatten_windows(labelled(spark, sf).where("reason = 'ok'"), 24), path)
    d = spark.read.option("header", True).csv(path)
    total = sum((F.col(f"r{i}").cast("double") for i in range(1, 25)), F.lit(0.0))
    return d.select("t0", r6(total, 3).alias("total"))


@query("s15_write_windows", f"WITH {WIN} SELECT satellite, strftime(s, {T}) AS date_start, label, round(check_ratio, 3) AS chk FROM fw WHERE reason = 'ok'")
def _(spark, sf):
    path, kept = fresh(spark, "windows"), labelled(spark, sf).where("reason = 'ok'")
    W.write_windows(kept, path)
    chk = F.aggregate(F.transform("xrs_flux_ratio", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return R.read_dataset(spark, path, kept.schema).select("satellite", "date_start", "label", r6(chk, 3).alias("chk"))


BOTH = f"""{GROUPED}, a AS (SELECT split, label, count(*) AS n FROM ni GROUP BY 1, 2),
z AS (SELECT 'per_label' AS category, split, label, n FROM a UNION ALL SELECT 'collapsed', split, CASE label WHEN 'NONE' THEN 'NONE' WHEN 'C' THEN 'OTHER' ELSE 'M+' END, sum(n)::BIGINT FROM a GROUP BY 2, 3)"""


def report(spark, sf):
    path = fresh(spark, "report")
    old, new = orders_items(spark, sf), grouped(spark, sf)
    W.write_split_report(path, S.compare_composition(old, new, "label"), S.compare_composition(old, new, "label", True),
                         S.movement_summary(old, new, "ar"), S.exclusivity(new, "ar"),
                         S.split_sizes_report(old, new, {"train": 70, "cv": 15, "test": 15}))
    return path


@query("s17_read_split_summaries", f"WITH {BOTH} SELECT category, split, label, n FROM z")
def _(spark, sf):
    d = R.read_split_summaries(spark, report(spark, sf), "*.txt")
    return d.select("category", "split", "label", "n")


@query("s18_write_split_report", f"""WITH {BOTH}, oc AS (SELECT split, label, count(*) AS n FROM oi GROUP BY 1, 2),
zo AS (SELECT 'composition' AS tab, split, label, n FROM oc UNION ALL SELECT 'collapsed', split, CASE label WHEN 'NONE' THEN 'NONE' WHEN 'C' THEN 'OTHER' ELSE 'M+' END, sum(n)::BIGINT FROM oc GROUP BY 2, 3),
zn AS (SELECT CASE category WHEN 'per_label' THEN 'composition' ELSE 'collapsed' END AS tab, split, label, n FROM z),
a_ AS (SELECT split, count(*) AS n, count(DISTINCT ar) AS g FROM oi GROUP BY 1), b_ AS (SELECT split, count(*) AS n, count(DISTINCT ar) AS g FROM ni GROUP BY 1)
SELECT coalesce(zo.tab, zn.tab) AS tab, coalesce(zo.split, zn.split) AS split, coalesce(zo.label, zn.label) AS name, coalesce(zo.n, 0) AS x, coalesce(zn.n, 0) AS y
FROM zo FULL JOIN zn ON zo.tab = zn.tab AND zo.split = zn.split AND zo.label = zn.label
UNION ALL SELECT 'movement', a_.split, 'groups', a_.g, b_.g FROM a_ JOIN b_ ON a_.split = b_.split
UNION ALL SELECT 'sizes', a_.split, 'items', a_.n, b_.n FROM a_ JOIN b_ ON a_.split = b_.split
UNION ALL SELECT 'exclusivity', '', 'groups', count(*), count(CASE WHEN k > 1 THEN 1 END) FROM (SELECT ar, count(DISTINCT split) AS k FROM ni GROUP BY 1)""")
def _(spark, sf):
    path = report(spark, sf)

    def part(tab: str, *cols):
        return spark.read.parquet(f"{path}/{tab}").select(F.lit(tab).alias("tab"), *[c.alias(n) for c, n in zip(cols, ("split", "name", "x", "y"))])
    c = F.col
    comp = [part(t, c("split"), c("label"), c("orig_n"), c("new_n")) for t in ("composition", "collapsed")]
    return comp[0].union(comp[1]).union(part("movement", c("split"), F.lit("groups"), c("groups_orig"), c("groups_new"))) \
        .union(part("sizes", c("split"), F.lit("items"), c("original"), c("achieved"))) \
        .union(part("exclusivity", F.lit(""), F.lit("groups"), c("n_groups"), c("n_violations")))


@query("s19_spot_check", f"WITH {CLIPS} SELECT ar, label, f0 AS fname_start, f2 AS fname_end FROM clips")
def _(spark, sf):
    path = fresh(spark, "spot")
    full = F.transform("filepaths", lambda p: F.concat(F.lit("/d/x/"), p))
    W.write_spot_check(clips(spark, sf).withColumn("filepaths", full), path, "filepaths", ["ar", "label"])
    return R.read_csv(spark, path, "ar long, label string, fname_start string, fname_end string")


@query("s20_write_predictions", f"WITH {CLIPS} SELECT ar, label AS label_pred, f0 || '|' || f1 || '|' || f2 AS files FROM clips")
def _(spark, sf):
    path = fresh(spark, "predictions")
    full = F.transform("filepaths", lambda p: F.concat(F.lit("/d/x/"), p))
    W.write_predictions(clips(spark, sf).select("ar", F.col("label").alias("label_pred"), full.alias("filepaths")), path, True)
    d = spark.read.schema("ar long, label_pred string, filepaths array<string>").json(path)
    return d.select("ar", "label_pred", F.array_join("filepaths", "|").alias("files"))


@query("s21_write_augmented", f"""WITH {AUG} SELECT 'stats' AS tab, coalesce(error, 'ok') AS name, count(*) AS n FROM au GROUP BY 2
UNION ALL SELECT 'rows', ar || ' ' || strftime(t_start, {T}), CASE WHEN error IS NULL THEN 16 ELSE 0 END FROM au""")
def _(spark, sf):
    path = fresh(spark, "augmented")
    W.write_augmented(augmented(spark, sf), path)
    rows = spark.read.parquet(f"{path}/rows").select(
        F.lit("rows").alias("tab"), F.concat_ws(" ", F.col("ar").cast("string"), stamp("t_start")).alias("name"),
        F.coalesce(F.size("xrs_flux_ratio"), F.lit(0)).cast("long").alias("n"))
    return spark.read.parquet(f"{path}/stats").select(F.lit("stats").alias("tab"), F.col("reason").alias("name"), "n").union(rows)


@query("s22_scaler_stats", f"WITH {MED} SELECT 'x' AS var, round(avg(x), 6) AS a, round(stddev_pop(x), 6) AS b FROM fin")
def _(spark, sf):
    path = fresh(spark, "stats")
    W.write_stats(V.fit_scaler(vecs(spark, sf), ["x"], "zscore"), path)
    return rnd(R.read_stats(spark, path), ["a", "b"])


@query("s23_write_distribution", f"""WITH {ORDERS} SELECT split, label AS name, count(*) AS n FROM oi GROUP BY 1, 2
UNION ALL SELECT split, CAST(ar AS VARCHAR), count(*) FROM oi GROUP BY 1, 2""")
def _(spark, sf):
    path = fresh(spark, "distribution")
    W.write_distribution(orders_items(spark, sf), path)
    parts = [R.read_csv(spark, f"{path}/{t}", "split string, name string, n long") for t in ("class_counts", "group_counts")]
    return parts[0].union(parts[1])


@query("s24_write_label_csv", f"WITH {FRAMES} SELECT file AS ImgName, label AS Label FROM frames")
def _(spark, sf):
    path = fresh(spark, "sorted")
    W.write_label_csv(frames(spark, sf), path, "ar", "ts", "file", "label")
    return R.read_csv(spark, path, "ImgName string, Label string")


@query("e2_image_items", f"""WITH {FRAMES} SELECT '/img/' || ar || '/' || file AS filepath, replace(file, '.png', '') AS sname, CASE WHEN label IN ('M', 'X') THEN 'M+' ELSE 'NONE' END AS label,
  CAST(CASE WHEN label IN ('M', 'X') THEN 1 ELSE 0 END AS BIGINT) AS id, ar, strftime(ts, {T}) AS t, label AS flare_type FROM frames WHERE ar <> 3""")
def _(spark, sf):
    f = frames(spark, sf)
    allow = f.where("ar <> 3").select("ar").distinct()
    d = image_items(f.select(F.col("file").alias("ImgName"), F.col("label").alias("Label")), "/img", "binary", "M", allow)
    return d.select("filepath", "sname", "label", F.col("id").cast("long").alias("id"), "ar",
                    stamp("timestamp").alias("t"), "flare_type")


