"""Sampling and split invariants over seeds and partitionings."""

import pytest
from pyspark.sql import functions as F

from flareframe.operators import sampling as M
from flareframe.operators import splits as S


@pytest.fixture(scope="module")
def items(spark):
    i = F.col("id")
    ar = F.when(i % 3 == 0, 0).when(i == 1, 1).otherwise(2 + i % 17)       # one hot group, one of size 1
    lab = F.when(i % 10 < 5, "NONE").when(i % 10 < 8, "C").when(i % 10 < 9, "M").otherwise("X")
    return spark.range(1000).select(i, ar.alias("ar"), lab.alias("label")).cache()


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_downsample_hits_the_total(items, seed):
    d = M.downsample(items, "id", "ar", "label", target_total=350, seed=seed)
    n = {r["label"]: r["n"] for r in d.where("keep").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert n == {"C": 150, "M": 100, "X": 100}          # all NONE go first, then half of C
    assert d.count() == 1000


def test_downsample_keeps_every_group_when_it_can(items):
    d = M.downsample(items, "id", "ar", "label", targets={"NONE": 60}, seed=5)
    kept = d.where("keep AND label = 'NONE'")
    assert kept.count() == 60
    groups = items.where("label = 'NONE'").select("ar").distinct().count()
    assert kept.select("ar").distinct().count() == groups
    assert M.before_after(d, "label", "ar").where("lost").count() == 0


def test_fewer_rows_than_groups_and_zero(items):
    d = M.downsample(items, "id", "ar", "label", targets={"NONE": 4, "C": 0}, seed=5).where("keep")
    n = d.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("ar").alias("g")).collect()
    assert {r["label"]: (r["n"], r["g"]) for r in n}["NONE"] == (4, 4)
    assert "C" not in {r["label"] for r in n}


def test_target_below_fixed_labels_fails(items):
    with pytest.raises(Exception, match="cannot be removed"):
        M.downsample_targets(items, "label", target_total=150).collect()


def test_same_sample_under_any_partitioning(items):
    a = M.sample_per_group(items.repartition(1), ["ar"], "id", 5, 7)
    b = M.sample_per_group(items.repartition(8, "label"), ["ar"], "id", 5, 7)
    assert {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()}
    assert a.groupBy("ar").count().agg(F.max("count")).first()[0] == 5


def test_weight_zero_comes_last(spark):
    d = spark.createDataFrame([(i, 0.0 if i < 5 else 1.0) for i in range(10)], "id long, w double")
    assert {r["id"] for r in M.weighted_sample(d, "id", "w", 5, 3).collect()} == set(range(5, 10))
    assert M.weighted_sample(d, "id", "w", 99, 3).count() == 10


def test_bootstrap_follows_weights(spark):
    d = spark.createDataFrame([(i, float(i % 4)) for i in range(40)], "id long, w double")
    b = M.weighted_bootstrap(d, "id", "w", 4000, 1)
    n = {r["w"]: r["n"] for r in b.groupBy("w").agg(F.count("*").alias("n")).collect()}
    assert sum(n.values()) == 4000 and 0.0 not in n
    assert 0.12 < n[1.0] / 4000 < 0.21 and 0.44 < n[3.0] / 4000 < 0.56


@pytest.mark.parametrize("strategy,want", [("downsample", None), ("downsample", {"NONE": 50, "C": 50, "M": 50, "X": 50}),
                                           ("oversample", {"NONE": 20, "C": 20, "M": 150, "X": 150})])
def test_stratified_split(items, strategy, want):
    d = M.stratified_split(items, "id", "label", (0.7, 0.15, 0.15), 3, want, strategy)
    base = d.where("copy = 0") if "copy" in d.columns else d
    assert base.count() == 1000 and base.select("id").distinct().count() == 1000
    n = {(r["split"], r["label"]): r["n"] for r in d.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    if want:
        assert {lab: n["train", lab] for lab in want} == want
    else:
        assert n["train", "NONE"] == 350 and n["cv", "C"] == 45
    assert sum(v for (s, _), v in n.items() if s == "test") <= 150


@pytest.mark.parametrize("even", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_group_split_never_straddles(items, even, seed):
    d = S.group_split(items, "ar", {"train": 700, "cv": 150, "test": 150}, seed, even=even)
    assert d.count() == 1000
    assert S.violations(d, "ar").count() == 0
    S.check_exclusive(d, "ar")
    n = {r["split"]: r["count"] for r in d.groupBy("split").count().collect()}
    assert sum(n.values()) == 1000


def test_group_larger_than_its_target(items):
    d = S.group_split(items, "ar", {"train": 100, "cv": 100, "test": 100}, 1)
    assert d.count() == 1000 and S.violations(d, "ar").count() == 0


def test_items_without_a_group_stay(items):
    d = items.withColumn("ar", F.when(F.col("id") % 10 != 0, F.col("ar")))
    for item in ("id", None):
        s = S.group_split(d, "ar", {"train": 70, "cv": 15, "test": 15}, 1, item=item)
        assert s.count() == 1000 and s.where("split IS NULL").count() == 0
        assert s.where("ar IS NULL").count() == 100
    k = M.downsample(items.withColumn("label", F.when(F.col("id") % 10 != 0, F.col("label"))), "id", "ar", "label",
                     targets={"NONE": 3}, seed=1)
    assert k.count() == 1000 and k.where("label IS NULL AND NOT keep").count() == 0


def test_rebalance_lowers_the_deviation(items):
    sizes = S.group_sizes(items, "ar")
    goal = {"train": 500, "cv": 300, "test": 200}
    plan = S.assign_cumulative(sizes, "ar", {"train": 90, "cv": 5, "test": 5}, 1)

    def off(p):
        n = {r["split"]: r["n"] for r in p.groupBy("split").agg(F.sum("size").alias("n")).collect()}
        return sum(abs(n.get(s, 0) - t) for s, t in goal.items())
    new = S.rebalance(plan, "ar", goal)
    assert new.count() == plan.count() and off(new) <= off(plan)


def test_missing_groups_and_leaks_raise(spark, items):
    bad = items.withColumn("ar", F.when(F.col("id") > 0, F.col("ar")))
    with pytest.raises(ValueError):
        S.require_groups(bad, "ar")
    assert S.require_groups(bad, "ar", allow_missing=True) is bad
    leak = items.withColumn("split", F.when(F.col("id") % 2 == 0, "train").otherwise("cv"))
    with pytest.raises(ValueError):
        S.check_exclusive(leak, "ar")


def _by_groups(plan, targets):
    """The rule of rebalance, group by group."""
    have = {s: sum(n for _, n, x in plan if x == s) for s in targets}
    out, line, to = {}, 0, {}
    for s, t in targets.items():
        run = 0
        for g, n, _ in sorted((p for p in plan if p[2] == s), key=lambda p: (p[1], p[0])):
            run += n
            out[g] = run <= have[s] - t
    for g, n, s in sorted(plan, key=lambda p: (p[1], p[0])):
        to[g] = s
        if out[g]:
            line += n
            below = 0
            for x, t in targets.items():
                room = max(t - have[x], 0)
                if below <= line - n / 2 < below + room:
                    to[g] = x
                below += room
    return to


def test_rebalance_by_classes_equals_groups(spark):
    import random
    rng = random.Random(12)
    for case in range(8):
        sizes = [rng.choice((1, 1, 1, 2, 3, rng.randint(1, 400))) for _ in range(rng.choice((5, 60, 400)))]
        plan = [(f"g{i:04d}", n, rng.choices(("train", "cv", "test"), (90, 5, 5) if case % 2 else (30, 60, 10))[0]) for i, n in enumerate(sizes)]
        total = sum(sizes)
        goal = {"train": total * 55 // 100, "cv": total // 4, "test": total // 5}
        df = spark.createDataFrame(plan, "ar string, size long, split string").repartition(3)
        new = S.rebalance(df, "ar", goal)
        assert {r.ar: r.split for r in new.collect()} == _by_groups(plan, goal)
        assert new._jdf.queryExecution().analyzed().toString().count("Relation") <= 4


def test_rebalance_leaves_a_good_plan(spark):
    df = spark.createDataFrame([("a", 5, "train"), (None, 3, "cv"), ("c", 2, "test")], "ar string, size long, split string")
    assert {r.ar: r.split for r in S.rebalance(df, "ar", {"train": 5, "cv": 3, "test": 2}).collect()} == {"a": "train", None: "cv", "c": "test"}
    assert S.rebalance(df.limit(0), "ar", {"train": 5, "cv": 3, "test": 2}).count() == 0


@pytest.mark.parametrize("limit", [1, 12, 1000])
def test_cut_offs_of_small_and_large_groups(spark, monkeypatch, limit):
    """Small groups are ranked whole, without the two passes that large ones take."""
    from flareframe.session import noted
    monkeypatch.setattr(M, "GROUP_LIMIT", limit)
    rows = [(g, g * 100 + i) for g in range(1, 7) for i in range(g * 5)] + [(None, 900 + i) for i in range(9)]
    df = spark.createDataFrame(rows, "g int, id long")
    quotas = spark.createDataFrame([(g, sum(r[0] == g for r in rows), k) for g, k in ((1, 2), (2, 0), (3, 15), (4, 7), (5, 24), (6, 1), (None, 4))],
                                   "g int, n long, k long")
    stored = []
    with noted(stored):
        got = M.first_k(df, ["g"], "id", 3, quotas, "__in").where("__in").collect()
    assert len(stored) == (2 if limit == 1000 else 3)
    u = {r.id: r.u for r in df.select("id", M.uniform(3, "id").alias("u")).collect()}
    want = set()
    for g, k in ((1, 2), (3, 15), (4, 7), (5, 24), (6, 1), (None, 4)):
        want |= set(sorted((r[1] for r in rows if r[0] == g), key=lambda i: (u[i], i))[:k])
    assert {r.id for r in got} == want
