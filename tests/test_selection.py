"""Selection by cut-offs against plain ranking."""

import random

import pytest
from flareframe.operators import sampling as M
from pyspark.sql import functions as F


def frame(spark):
    rng, rows = random.Random(3), []
    for g, n in (("a", 4000), ("b", 300), ("c", 30), ("d", 1), (None, 500)):
        rows += [(g, i % 3 if g != "c" else None, len(rows) + i) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, h int, id long").repartition(7)


def ranks(df, keys, seed):
    groups = {}
    for r in df.withColumn("u", M.uniform(seed, "id")).collect():
        groups.setdefault(tuple(r[k] for k in keys), []).append((r.u, r.id))
    return {k: [i for _, i in sorted(v)] for k, v in groups.items()}


@pytest.mark.parametrize("spread,margin", [(6.0, 12.0), (0.0, 0.5)])        # the second makes most brackets miss
def test_first_k_equals_ranking(spark, monkeypatch, spread, margin):
    monkeypatch.setattr(M, "SPREAD", spread)
    monkeypatch.setattr(M, "MARGIN", margin)
    df, keys = frame(spark), ["g", "h"]
    want = ranks(df, keys, 5)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    for share in (0.0, 0.01, 0.4, 0.99, 1.0, 3.0):
        quotas = sizes.withColumn("k", F.floor(F.col("n") * share)).where("g IS NULL OR g <> 'b'")
        got = M.first_k(df, keys, "id", 5, quotas, "picked")
        assert got.columns == [*df.columns, "picked"] and got.count() == df.count()
        picked = {}
        for r in got.where("picked").collect():
            picked.setdefault((r.g, r.h), set()).add(r.id)
        expected = {k: set(v[:int(len(v) * share)]) for k, v in want.items() if k[0] != "b" and int(len(v) * share)}
        assert picked == expected


def test_brackets_are_narrow(spark):
    """What is ranked is the bracket, not the group."""
    df = spark.range(200_000).select(F.lit("x").alias("g"), "id").repartition(4)
    quotas = spark.createDataFrame([("x", 200_000, 2_000)], "g string, n long, k long")
    edge = M.cut_offs(df, ["g"], "id", 1, quotas).first().edge
    u = sorted(r[0] for r in df.select(M.uniform(1, "id")).collect())
    assert edge.u == u[1999]
    half = M.SPREAD * 2000 ** 0.5 + M.MARGIN
    assert sum((2000 - half) / 200_000 <= x < (2000 + half) / 200_000 for x in u) < 1000


def test_sample_per_group(spark):
    df = frame(spark)
    want = ranks(df, ["g"], 9)
    for k in (2, 100_000):
        got = {}
        for r in M.sample_per_group(df, ["g"], "id", k, 9).collect():
            got.setdefault((r.g,), set()).add(r.id)
        assert got == {g: set(v[:k]) for g, v in want.items()}
    by_column = M.sample_per_group(df.withColumn("k", F.when(F.col("g") == "a", 1500).otherwise(0)), ["g"], "id", F.col("k"), 9)
    assert {r.id for r in by_column.collect()} == set(want[("a",)][:1500])
    plan = M.sample_per_group(df, ["g"], "id", 3, 9)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan                          # each task sends at most 3 rows of a group


def test_empty_table(spark):
    none = spark.createDataFrame([], "g string, id long")
    assert M.sample_per_group(none, ["g"], "id", F.lit(4), 1).count() == 0
