"""Segmented computations equal plain windows, whatever the segments and keys."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from flareframe.operators import ordered as O


def frame(spark, n=3000):
    """One key holds most rows, one key is null, values have gaps, times repeat."""
    i = F.col("id")
    key = F.when(i % 3 != 0, F.lit(1)).when(i % 7 == 0, F.lit(2)).when(i % 5 == 0, F.lit(3))
    return spark.range(n).select(
        i, key.alias("k"), F.timestamp_seconds((i * 7919) % 5000 * 60).cast("timestamp_ntz").alias("ts"),
        F.when(F.hash(i) % 3 == 0, (i % 100).cast("double")).alias("v"))


def test_running_equals_window(spark):
    d = frame(spark)
    out = O.running(d, ["k"], ["ts", "id"], O.time_segment("ts", "1 hour"), s=("sum", F.col("v")),
                    m=("max", F.col("v")), a=("last", F.col("v")), b=("prev", F.col("v")),
                    c=("next", F.col("v")), e=("following", F.col("v")))
    w = Window.partitionBy("k").orderBy("ts", "id")
    up, down = (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)
    out = out.withColumns({
        "s2": F.sum("v").over(w.rowsBetween(*up)), "m2": F.max("v").over(w.rowsBetween(*up)),
        "a2": F.last("v", True).over(w.rowsBetween(*up)),
        "b2": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "c2": F.first("v", True).over(w.rowsBetween(*down)),
        "e2": F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    bad = " OR ".join(f"NOT ({x} <=> {x}2)" for x in "smabce")
    assert out.count() == 3000
    assert out.where(bad).count() == 0


def test_number_rows_keeps_null_keys_and_null_times(spark):
    d = frame(spark).withColumn("ts", F.when(F.col("id") % 11 != 0, F.col("ts")))
    out = O.number_rows(d, ["k"], ["ts", "id"], O.time_segment("ts"))
    w = Window.partitionBy("k").orderBy("ts", "id")
    out = out.withColumn("rn2", F.row_number().over(w))
    assert out.count() == 3000 and out.where("rn <> rn2").count() == 0


def test_context_blocks(spark):
    d = O.number_rows(frame(spark), ["k"], ["ts", "id"], O.time_segment("ts"))
    b = O.with_context(d, before=5, after=9, block=64)
    w = O.block_window(["k"])
    out = O.home(b.withColumns({"p": F.lag("id", 5).over(w), "n": F.lead("id", 9).over(w)}))
    x = Window.partitionBy("k").orderBy("rn")
    out = out.withColumns({"p2": F.lag("id", 5).over(x), "n2": F.lead("id", 9).over(x)})
    assert out.count() == 3000
    assert out.where("NOT (p <=> p2) OR NOT (n <=> n2)").count() == 0
    # no block holds more than its rows plus the context
    assert b.groupBy("k", O.BLOCK).count().agg(F.max("count")).first()[0] <= 64 + 14


def test_quantile_segments_are_monotone(spark):
    d = frame(spark).withColumn("x", F.pow(F.col("id").cast("double"), 3))
    s = O.with_quantile_segment(d, "x", 16).groupBy("__qseg").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).orderBy("__qseg").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(s, s[1:]))
    assert max(r["n"] for r in s) < 3000 / 4


def test_materialise_goes_to_the_named_folder(spark, tmp_path, monkeypatch):
    from flareframe import session
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    assert session.materialise(spark.range(5)).count() == 5
    assert any(tmp_path.iterdir())


def test_shared_folder_comes_from_the_session():
    from flareframe.session import shared_dir

    class Conf:
        def get(self, key, default):
            return "/shared/run/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert shared_dir(Session()) == "/shared/run"
