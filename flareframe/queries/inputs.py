"""The driver's tables seen as forecasting data, in Spark and in SQL.

Each concept has a function (Spark) and a constant (a SQL common table
expression of the same rows), so queries and checks start from equal inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flareframe.functions import labels as L
from flareframe.operators.grid import bin_start
from flareframe.operators.ordered import micros
from flareframe.operators.sampling import uniform

# Event type to event class.
EVENT_CLASS = {"error": "X", "purchase": "M", "signup": "C", "click": "B", "view": "A"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def u_sql(seed: int | str, *ids: str) -> str:
    text = " || ':' || ".join([f"'{seed}'"] + [f"CAST({i} AS VARCHAR)" for i in ids])
    return (f"((CAST(('0x' || substr(md5({text}), 1, 8))::BIGINT AS DOUBLE)"
            " + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))")


CLASS_SQL = ("CASE event_type WHEN 'error' THEN 'X' WHEN 'purchase' THEN 'M' WHEN 'signup' THEN 'C'"
             " WHEN 'click' THEN 'B' WHEN 'view' THEN 'A' END")
SEV_SQL = ("CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3"
           " WHEN 'click' THEN 2 WHEN 'view' THEN 1 END")


def sev_to_class_sql(s: str) -> str:
    return (f"CASE {s} WHEN 5 THEN 'X' WHEN 4 THEN 'M' WHEN 3 THEN 'C' WHEN 2 THEN 'B'"
            " WHEN 1 THEN 'A' ELSE 'NONE' END")


def class_to_sev_sql(s: str) -> str:
    return (f"CASE {s} WHEN 'X' THEN 5 WHEN 'M' THEN 4 WHEN 'C' THEN 3 WHEN 'B' THEN 2"
            " WHEN 'A' THEN 1 WHEN 'NONE' THEN 0 END")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image items: one per event; entity = user."""
    e = table(spark, sf_dir, "events")
    cls = L.lookup(EVENT_CLASS, F.col("event_type"))
    lab = L.fold_ab(cls)
    name = F.concat(F.col("user_id").cast("string"), F.lit("_hmi.M_720s."),
                    F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_TAI.png"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("ar"), "ts",
                    cls.alias("flare_type"), lab.alias("label"),
                    L.lookup(L.LABEL_ID, lab).alias("flare_id"), "value",
                    F.concat(F.lit("data/"), F.col("user_id").cast("string"), F.lit("/"), name)
                    .alias("filepath"))


ITEMS = f"""items AS (SELECT event_id AS id, user_id AS ar, ts, {CLASS_SQL} AS flare_type,
  CASE event_type WHEN 'error' THEN 'X' WHEN 'purchase' THEN 'M' WHEN 'signup' THEN 'C' ELSE 'NONE' END AS label,
  CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS flare_id,
  value, 'data/' || user_id || '/' || user_id || '_hmi.M_720s.' || strftime(ts, '%Y%m%d_%H%M%S') || '_TAI.png' AS filepath
  FROM events)"""


def flare_events(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """Event intervals: start at ts, (value mod 60) minutes long; key = user mod 8."""
    e = table(spark, sf_dir, "events")
    end = micros("ts") + (F.floor(F.col("value")) % 60).cast("long") * 60_000_000
    cls = L.lookup(EVENT_CLASS, F.col("event_type"))
    d = e.select((F.col("user_id") % 8).alias("ar"), F.col("event_id").alias("id"),
                 F.col("ts").alias("t_occ"), cls.alias("class"), L.severity(cls).alias("sev"),
                 F.col("ts").alias("timestamp_start"),
                 F.timestamp_micros(end).cast("timestamp_ntz").alias("timestamp_end"),
                 F.concat(cls, F.lit("1.0")).alias("flare_type"))
    return d if keyed else d.drop("ar")


FLARES = f"""flares AS (SELECT user_id % 8 AS ar, event_id AS id, ts AS t_occ, {CLASS_SQL} AS class,
  {SEV_SQL} AS sev, ts AS timestamp_start,
  ts + to_minutes(CAST(CAST(floor(value) AS BIGINT) % 60 AS BIGINT)) AS timestamp_end,
  {CLASS_SQL} || '1.0' AS flare_type FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly frames of 8 entities (user mod 8), with real gaps; label = worst class in the hour."""
    e = table(spark, sf_dir, "events")
    sev = L.severity(L.lookup(EVENT_CLASS, F.col("event_type")))
    g = e.groupBy((F.col("user_id") % 8).alias("ar"), bin_start("ts", "1 hour").alias("ts")) \
        .agg(F.max(sev).alias("sev"), F.sum("value").alias("v"))
    lab = L.fold_ab(L.class_of_severity(F.col("sev")))
    return g.select("ar", "ts", lab.alias("label"), r6("v", 2).alias("v"), F.concat(
        F.col("ar").cast("string"), F.lit("_hmi.M_720s."), F.date_format("ts", "yyyyMMdd_HHmmss"),
        F.lit("_TAI.png")).alias("file"))


FRAMES = f"""frames0 AS (SELECT user_id % 8 AS ar, date_trunc('hour', ts) AS ts, max({SEV_SQL}) AS sev,
  round(sum(value), 2) AS v FROM events GROUP BY 1, 2),
frames AS (SELECT ar, ts, CASE sev WHEN 5 THEN 'X' WHEN 4 THEN 'M' WHEN 3 THEN 'C' ELSE 'NONE' END AS label, v,
  ar || '_hmi.M_720s.' || strftime(ts, '%Y%m%d_%H%M%S') || '_TAI.png' AS file FROM frames0)"""


def flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flux samples: satellite = event type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("satellite"), "ts",
                                                 F.col("value").alias("flux"))


FLUX = "flux AS (SELECT event_type AS satellite, ts, value AS flux FROM events)"

# hourly flux on the full grid of each satellite, empty hours null
HOURLY = FLUX + """, hb AS (SELECT satellite, date_trunc('hour', ts) AS ts, avg(flux) AS flux FROM flux GROUP BY 1, 2),
hg AS (SELECT satellite, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hb GROUP BY 1),
hourly AS (SELECT hg.satellite, hg.ts, hb.flux FROM hg LEFT JOIN hb ON hg.satellite = hb.satellite AND hg.ts = hb.ts)"""


def background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw background samples: the 8-hour maximum per satellite."""
    f = flux(spark, sf_dir)
    return f.groupBy("satellite", bin_start("ts", "8 hours").alias("ts")) \
        .agg(F.max("flux").alias("background"))


BACKGROUND = """bgraw AS (SELECT satellite, to_timestamp(floor(epoch(ts) / 28800) * 28800)::TIMESTAMP AS ts,
  max(flux) AS background FROM flux GROUP BY 1, 2),
bgday AS (SELECT satellite, CAST(ts AS DATE) AS date, min(ts) AS ts, arg_min(background, ts) AS background
  FROM bgraw GROUP BY 1, 2)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary probabilities over all line items: P = quantity / 50, positive = returned."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
                     (F.col("l_quantity") / 50).alias("p"),
                     (F.col("l_returnflag") == "R").cast("int").alias("y"),
                     (F.col("l_suppkey") % 3).alias("run"))


SCORES = """scores AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity / 50 AS p,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_suppkey % 3 AS run FROM lineitem)"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class truth and forecast over all line items."""
    li = table(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    yhat = F.when(F.col("l_quantity") <= 12, 0).when(F.col("l_quantity") <= 38, 1).otherwise(2)
    return li.select(y.alias("y"), yhat.alias("yhat"))


CLASSES = """classes AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
  CASE WHEN l_quantity <= 12 THEN 0 WHEN l_quantity <= 38 THEN 1 ELSE 2 END AS yhat FROM lineitem)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-class and ordinal logits: logit j is twice the sum of every fourth component from the j-th on."""
    e = table(spark, sf_dir, "embeddings")
    x = F.array(*[F.aggregate(F.filter("embedding", lambda v, i: i % 4 == j), F.lit(0.0),
                              lambda a, v: a + v.cast("double")) * 2.0 for j in range(4)])
    return e.select(F.col("vec_id").alias("id"), (F.col("label") % 4).alias("y"), x.alias("logits"),
                    F.slice(x, 1, 3).alias("ologits"),
                    F.transform(F.array(F.lit(1), F.lit(2), F.lit(4)), lambda b: F.floor(
                        F.col("label") / b).cast("int") % 2).alias("bits"))


LOGITS = """lg AS (SELECT vec_id AS id, label % 4 AS y, label,
  list_sum(CAST(list_slice(embedding, 1, len(embedding), 4) AS DOUBLE[])) * 2 AS x0,
  list_sum(CAST(list_slice(embedding, 2, len(embedding), 4) AS DOUBLE[])) * 2 AS x1,
  list_sum(CAST(list_slice(embedding, 3, len(embedding), 4) AS DOUBLE[])) * 2 AS x2,
  list_sum(CAST(list_slice(embedding, 4, len(embedding), 4) AS DOUBLE[])) * 2 AS x3 FROM embeddings)"""

# one row per (id, class j)
LONG = LOGITS + """, ll AS (SELECT id, y, label, unnest([0, 1, 2, 3]) AS j, unnest([x0, x1, x2, x3]) AS x FROM lg),
lp AS (SELECT id, y, label, j, x, exp(x - max(x) OVER (PARTITION BY id))
  / 1.0 AS e FROM ll),
soft AS (SELECT id, y, label, j, x, e / sum(e) OVER (PARTITION BY id) AS p FROM lp)"""

# ordinal: three cumulative probabilities per row
ORD = LOGITS + """, og AS (SELECT id, y, 1 / (1 + exp(-x0)) AS g1, 1 / (1 + exp(-x1)) AS g2,
  1 / (1 + exp(-x2)) AS g3, x0, x1, x2 FROM lg)"""


def orders_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled items of customers: class from the order priority, item-level random split."""
    o = table(spark, sf_dir, "orders")
    lab = F.when(F.col("o_orderpriority").startswith("1"), "X") \
        .when(F.col("o_orderpriority").startswith("2"), "M") \
        .when(F.col("o_orderpriority").startswith("3"), "C").otherwise("NONE")
    u = uniform(7, "o_orderkey")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ar"),
                    lab.alias("label"), F.col("o_orderdate").alias("ts"),
                    F.when(u < 0.7, "train").when(u < 0.85, "cv").otherwise("test").alias("split"))


ORDERS = f"""oi AS (SELECT o_orderkey AS id, o_custkey AS ar,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'X' WHEN '2' THEN 'M' WHEN '3' THEN 'C' ELSE 'NONE' END AS label,
  o_orderdate AS ts, CASE WHEN {u_sql(7, 'o_orderkey')} < 0.7 THEN 'train'
    WHEN {u_sql(7, 'o_orderkey')} < 0.85 THEN 'cv' ELSE 'test' END AS split FROM orders)"""

# customers to splits in random order against cumulative targets 70/15/15
GROUPED = ORDERS + f""", gs AS (SELECT ar, count(*) AS size FROM oi GROUP BY 1),
gu AS (SELECT ar, size, sum(size) OVER (ORDER BY {u_sql(42, 'ar')}, ar) AS cum, sum(size) OVER () AS total FROM gs),
gp AS (SELECT ar, size, CASE WHEN (cum - size / 2.0) / total < 70.0 / 100 THEN 'train'
  WHEN (cum - size / 2.0) / total < 85.0 / 100 THEN 'cv' ELSE 'test' END AS split FROM gu),
ni AS (SELECT oi.id, oi.ar, oi.label, oi.ts, gp.split FROM oi JOIN gp USING (ar))"""
