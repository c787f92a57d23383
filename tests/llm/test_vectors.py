"""Lattice hashing against all pairs."""

import numpy as np
from conftest_llm import merge
from flareframe.llm.op9_embedding_dedup import decode_e8, near_vectors
from pyspark.sql import functions as F


def brute(ids, x, cosine):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(u @ u.T >= cosine - 1e-12)
    links = [(ids[a], ids[b]) for a, b in zip(i, j) if a < b]
    deg = dict.fromkeys(ids, 0)
    for a, b in links:
        deg[a] += 1
        deg[b] += 1
    return deg, merge(ids, links)


def test_decoding_finds_nearest_points():
    x = np.random.default_rng(1).normal(size=(500, 8)) * 2
    near, other, gap = decode_e8(x)
    for p in (near, other):
        half = p % 2
        assert ((half.sum(1) == 0) | (half.sum(1) == 8)).all() and (p.sum(1) % 4 == 0).all()
    assert (gap >= 0).all() and ((x - near / 2) ** 2).sum(1).max() <= 1 + 1e-9      # covering radius 1


def test_recall_counts_and_components(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 64))
    x = np.concatenate([base, base[:60] + 0.12 * rng.normal(size=(60, 64)), base[0] + 0.05 * rng.normal(size=(150, 64))])
    ids = [int(i) for i in rng.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, id int")
    got = {r.vec_id: r for r in near_vectors(df.repartition(6), block=40).collect()}      # cells of several blocks
    deg, comp = brute(ids, x, 0.9)
    assert all(got[i].n_links <= deg[i] for i in ids)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(deg.values())
    assert np.mean([got[i].component_id == comp[i] for i in ids]) > 0.98
    whole = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, block=4000).collect()}
    assert whole == {i: (r.n_links, r.component_id) for i, r in got.items()}


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]),
            (7, [1.0, float("nan"), 3.0]), (8, [float("inf"), 2.0, 3.0]), (9, [1.0, 2.0, 3.0, 0.0]), (10, v), (10, v), (None, v)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)))
    out = sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=str)
    assert len(out) == 12
    linked = {o[0]: o[1] for o in out}
    assert [o[1:] for o in out if o[0] in (1, 2, 10, None)] == [(4, 1)] * 5          # repeated and null ids are vectors of their own
    assert all(linked[i] == 0 for i in (3, 4, 5, 6, 7, 8, 9))
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_rows_with_null_ids(spark):
    """Each null-id vector is looked up; a null id is never the smallest."""
    rows = [(None, [1.0, 0.0]), (None, [0.0, 1.0]), (None, [1.0, 0.01]), (4, [0.0, 2.0]), (3, [-1.0, 0.0]), (3, [0.0, -1.0]), (9, [-1.0, 0.01])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(None, 1, None), (None, 1, None), (None, 1, 4), (4, 1, 4), (3, 1, 3), (9, 1, 3), (3, 0, 3)], key=str)


def test_equal_vectors_are_one_class(spark):
    """Copies are counted, not compared: links are those of all pairs."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 64))
    base[1] = base[0] + 0.05 * rng.normal(size=64)
    x = np.concatenate([np.repeat(base[:1], 400, 0), np.repeat(base[1:2], 30, 0), base[2:]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert got == {i: (429, 0) if i < 430 else (0, i) for i in range(len(x))}


def test_recall_by_band_at_the_defaults(spark):
    """Random pairs at given cosines, production parameters: share of links found."""
    rng, rows, band = np.random.default_rng(8), [], {}
    for c in (0.9005, 0.905, 0.91, 0.92, 0.93, 0.95, 0.98):
        for _ in range(400):
            a, b = rng.normal(size=(2, 64))
            a /= np.linalg.norm(a)
            b -= (a @ b) * a
            b /= np.linalg.norm(b)
            band[len(rows)] = c
            rows += [(len(rows), a.tolist()), (len(rows) + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    got = {r.vec_id: r.component_id for r in near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)).collect()}
    recall = {c: np.mean([got[i + 1] == got[i] for i, x in band.items() if x == c]) for c in sorted(set(band.values()))}
    print(recall)
    assert min(recall.values()) >= 0.9 and all(recall[c] > 0.97 for c in (0.93, 0.95, 0.98))
