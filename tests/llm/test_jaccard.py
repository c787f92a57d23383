"""The Jaccard join against all pairs."""

import random

from conftest_llm import jaccard_sets, merge
from flareframe.llm import op7_jaccard_join as j
from flareframe.llm.common import components
from pyspark.sql import functions as F


def brute(rows, k, percent):
    s = jaccard_sets(rows, k)
    ids = list(s)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x]
             if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    comp = merge(ids, links)
    return {i: (len(s[i]), comp[i]) for i in ids}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randint(0, 10 ** 6)}"
    return " ".join(w)


def group_rows():
    rng, rows = random.Random(9), []
    for g, (size, length) in enumerate([(90, 60), (70, 150), (12, 40), (5, 200), (3, 4), (40, 9)]):
        base = [f"g{g}w{rng.randint(0, 500)}" for _ in range(length)]
        rows += [(g * 1000 + i, edited(rng, base, rng.randint(0, 4))) for i in range(size)]
    return rows


def test_given_documents(docs, odd_docs):
    for k, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.similar_documents(docs, k, percent).collect()}
        assert got == brute(odd_docs, k, percent)


def test_large_groups_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 8)
    monkeypatch.setattr(j, "RARE", 4)
    rows = group_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for k, percent in ((3, 90), (2, 70), (3, 60)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.similar_documents(df, k, percent).collect()}
        want = brute(rows, k, percent)
        assert {i: (v, want[i]) for i, v in got.items() if v != want[i]} == {}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randint(0, 80), 100 + rng.randint(0, 80)) for _ in range(60)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = sorted({x for e in edges if e[0] != e[1] for x in e})
    assert got == merge(ids, [e for e in edges if e[0] != e[1]])


def test_odd_ids(spark, no_docs):
    t = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(3, t), (3, t), (2, t), (None, t), (None, "b c d e f g"), (5, ""), (6, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in j.similar_documents(df.withColumn("node", F.lit(1))).collect()), key=str)
    assert got == sorted([(3, 2), (3, 2), (2, 2), (None, 2), (None, None), (5, 5), (6, 6)], key=str)
    assert j.similar_documents(no_docs).count() == 0


def test_large_group_of_sets_not_similar_enough(spark, monkeypatch):
    rng, given = random.Random(4), []
    base = [f"w{i}" for i in range(100)]
    rows = [(i, edited(rng, base, 3)) for i in range(150)] + [(500 + i, edited(rng, base, 1)) for i in range(30)]
    verified = j._verified

    def counted(pairs, *rest):
        given.append(pairs.count())
        return verified(pairs, *rest)
    monkeypatch.setattr(j, "_verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.similar_documents(df, 3, 90).collect()}
    assert got == brute(rows, 3, 90)
    assert given[-1] < 5 * len(rows)                           # what no link connects is not listed pair by pair (there are 16110)


def test_tokens_that_must_be_shared(spark):
    rng = random.Random(2)
    for percent in (60, 80, 90):
        sizes, shared = [], []
        for _ in range(150):
            common, a, b = rng.randint(1, 150), rng.randint(0, 15), rng.randint(0, 15)
            order = rng.sample(range(1000), common + a + b)
            p, q = sorted(order[:common + a]), sorted(order[:common] + order[common + a:])
            if p != q and j.linked(common, len(p), len(q), percent):
                sizes.append((len(sizes), len(p), len(q)))
                shared.append((p, q))
        cols = [F.col("i"), j.prefix_size(F.col("a"), percent), j.prefix_size(F.col("b"), percent), j.must_share(F.col("a"), F.col("b"), percent)]
        for i, x, y, least in spark.createDataFrame(sizes, "i int, a long, b long").select(*cols).collect():
            assert len(set(shared[i][0][:x]) & set(shared[i][1][:y])) >= least
        assert len(sizes) > 20
