"""Quality rules, decontamination, the pipeline and the registration."""

import re

import numpy as np
import pytest
from conftest_llm import LOW, jaccard_sets, merge
from flareframe.llm import op4_decontamination as d4
from flareframe.llm.op2_quality import STATS, fit_quality, fit_rules, score_quality, stats_of, text_stats
from flareframe.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_rules_are_sparse_and_right():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, len(STATS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.2) | (x[:, 1] > 1.2)).astype(float)
    m = fit_rules(x, y)
    assert 0 < len(m.rules) < 120

    def score(v):
        t = m.bias + sum(w for r, w in m.rules if all((v[STATS.index(s)] > c) == up for s, up, c in r))
        return 1 / (1 + np.exp(-t))
    x2 = rng.normal(size=(500, len(STATS)))
    y2 = (x2[:, 3] > 0.5) & (x2[:, 7] < 0.2) | (x2[:, 1] > 1.2)
    assert np.mean([(score(v) >= 0.5) == t for v, t in zip(x2, y2)]) > 0.93


def test_expression_equals_rules(spark, docs):
    x = np.array([stats_of(f"word{i} " * (i + 1) + "!" * (i % 7)) for i in range(300)])
    m = fit_rules(x, (np.arange(300) % 7 > 3).astype(float))
    rows = text_stats(docs.select(F.col("doc_id").alias("id"), "text")).withColumn("score", m.score()).collect()
    for r in rows:
        t = m.bias + sum(w for rule, w in m.rules if all((r[s] > c) == up for s, up, c in rule))
        assert r.score == pytest.approx(1 / (1 + np.exp(-t)))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = score_quality(docs, fit_quality(docs, labels.where(~held))).join(labels, "doc_id").where(held).collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in got]) > 0.93


def test_scores_of_odd_rows_and_labels(spark, docs, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_quality(docs, fit_quality(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (7, 1), (7, None), (-5, 0), (None, 1)], "doc_id long, quality int")
    s = score_quality(docs, fit_quality(docs, one)).collect()
    assert len(s) == len(odd_docs) and all(0.5 < r.score <= 1 for r in s)
    assert score_quality(no_docs, fit_quality(no_docs, one)).count() == 0


def brute(rows, items, n, share):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    wins = {}
    for i, t in items:
        w = words(t)
        m = min(n, len(w))
        for s in range(len(w) - m + 1 if w else 0):
            wins.setdefault(tuple(w[s:s + m]), set()).add(str(i))
    out = {}
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for m in {len(k) for k in wins}:
            for s in range(len(w) - m + 1):
                if tuple(w[s:s + m]) in wins:
                    hit.update(range(s, s + m))
                    found |= wins[tuple(w[s:s + m])]
        out[d] = (len(w), len(hit), sorted(found), bool(hit) and share * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("limit", [32 << 20, 0])               # with and without broadcasting the terms
def test_contamination(spark, docs, odd_docs, monkeypatch, limit):
    monkeypatch.setattr(d4, "MAX_BROADCAST_BYTES", limit)
    long = next(t for d, t in odd_docs if d == 0)
    items = [(1, " ".join(long.split()[5:40])), (2, "w1"), (3, "The, OF"), (4, None), (5, "..."), (6, "never seen words " * 9),
             (7, " ".join(long.split()[-20:])), (8, " ".join(long.split()[-20:])), (9, "the " * 20), (10, "é ü ß 中文")]
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1)).withColumn("id", F.lit(2))
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in d4.contamination(docs, it).collect()}
    want = brute(odd_docs, items, 13, 20)
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {}
    assert sum(v[3] for v in got.values()) > 5


def test_contamination_of_odd_tables(spark, docs, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in d4.contamination(docs, none).collect()} == {False}
    assert d4.contamination(no_docs, none).count() == 0
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c d e f"), (None, "a b c"), (None, None)], "doc_id long, text string")
    it = spark.createDataFrame([(None, "a b"), (3, "b c")], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in d4.contamination(df, it).collect()), key=str)
    assert got == [(1, 3, 3, ["3"]), (1, 6, 3, ["3"]), (None, 0, 0, []), (None, 3, 3, ["3"])]   # null ids are looked up
    twice = spark.createDataFrame([(1, "x a b y"), (1, "q q q"), (None, "b c"), (None, "c b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit) for r in d4.contamination(twice, it).collect()), key=str)
    assert got == [(1, 3, 0), (1, 4, 2), (None, 2, 0), (None, 2, 2)]                            # each row by its own text


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "x x alpha y beta x gamma"), (2, "alpha x x x x x x x x x beta gamma"), (3, "gamma alpha beta")],
                                 "id long, text string")
    items = spark.createDataFrame([("i", ["alpha", "beta", "gamma"])], "item_id string, w array<string>")
    got = {(r.id, r.item_id) for r in d4.PositionalIndex(docs, items).near(within=5).collect()}
    assert got == {(1, "i"), (3, "i")}


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from flareframe.llm.op7_jaccard_join import similar_documents
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for _, stage in p.STAGES[:-1]:
        new = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert new.columns == docs.columns and new.count() <= docs.count()
        kept.append(new.count())
        docs = new
    assert 0 < kept[-1] < 200
    assert similar_documents(docs, 5, 80).where("doc_id <> component_id").count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert d4.contamination(docs, bench).where("contaminated").count() == 0
    last = p.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == kept[-1]
    assert p.run(spark, SF).select("doc_id").distinct().count() == kept[-1]


def test_pipeline_stages_judge_rows(spark):
    """Null ids, repeated ids and rows, null texts, clashing names: every stage against plain Python, row by row."""
    import corpus_pipeline as p
    base = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").limit(60).collect()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    passage = max((t for _, t in bench if t), key=len)
    prose = [" ".join(f"q{i}y{j}" for j in range(30)) for i in range(8)]
    rows = [(r.doc_id, r.text) for r in base] + [(None, r.text) for r in base[:12]] + [(base[0].doc_id, r.text) for r in base[20:32]]
    rows += [(9001, prose[0] + "\nCommon line"), (9001, prose[0] + "\nCommon line"), (9001, prose[0] + "\nCommon line"),
             (None, prose[1]), (None, prose[1]), (9003, prose[2] + " end"), (None, prose[2]), (9002, prose[2] + " end"),
             (None, None), (9004, None), (9004, ""), (None, passage), (9005, passage), (9005, prose[3]), (9006, prose[4])]
    rows += [(9100 + i, f"z{i}\ncommon LINE ") for i in range(9)] + [(None, "n1\ncommon line"), (None, "n2\ncommon line\nn3")]
    rows = [(d, t, len(t or ""), i) for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, tag int").repartition(4)
    for c in ("id", "row", "key", "n", "log_bytes", "label", "r", "g"):
        df = df.withColumn(c, F.col("tag") + 1)
    model = fit_quality(df, spark.read.parquet(f"{SF}/labels.parquet"))

    def score(t):
        v = dict(zip(STATS, stats_of(t)))
        return 1 / (1 + np.exp(-model.bias - sum(w for r, w in model.rules if all((v[s] > c) == up for s, up, c in r))))
    has = {}                                                  # line to the ids that have it; null is one id
    for d, t, _, _ in rows:
        for x in (t or "").split("\n"):
            has.setdefault(x.strip(" \t\n\x0b\x0c\r").translate(LOW), set()).add(d)
    kept_lines = {i: "\n".join(x for x in (t or "").split("\n") if not (k := x.strip(" \t\n\x0b\x0c\r").translate(LOW))
                               or len(has[k]) < 10) for _, t, _, i in rows}
    assert sum(kept_lines[i] != (t or "") for _, t, _, i in rows) > 10
    sets = jaccard_sets([(i, t) for _, t, _, i in rows], 5)
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    group, least = merge(sets, links), {}
    for d, _, _, i in rows:
        k = (d is None, d or 0)
        least[group[i]] = min(least.get(group[i], k), k)
    hit = brute([(i, t) for _, t, _, i in rows], bench, 13, 20)
    got = {f: sorted(f(spark, df, SF).collect(), key=lambda r: r.tag) for f in (
        p.keep_good, p.drop_shared_lines, p.keep_one_of_each_group, p.drop_contaminated)}
    for f, out in got.items():
        assert f(spark, df, SF).columns == df.columns
        for r in out:                                         # no row twice, and no row's columns mixed with another's
            d, t, n, i = rows[r.tag]
            assert r.doc_id == d and all(r[c] == i + 1 for c in ("id", "row", "key", "n", "log_bytes", "label", "r", "g"))
            if f is not p.drop_shared_lines:
                assert (r.text, r.n_chars) == (t, n)
        assert len({r.tag for r in out}) == len(out)
    assert {r.tag for r in got[p.keep_good]} == {i for _, t, _, i in rows if score(t) >= p.MIN_QUALITY}
    assert {r.tag: (r.text, r.n_chars) for r in got[p.drop_shared_lines]} == {i: (t, len(t)) for i, t in kept_lines.items()}
    one = [r.tag for r in got[p.keep_one_of_each_group]]
    assert sorted(group[i] for i in one) == sorted(least)
    assert all(least[group[i]] == (rows[i][0] is None, rows[i][0] or 0) for i in one)
    assert {r.tag for r in got[p.drop_contaminated]} == {i for _, _, _, i in rows if not hit[i][3]} != {r[3] for r in rows}
    pieces = p.pack_windows(spark, df, SF).groupBy("doc_id").agg(F.sum((F.col("start") == 0).cast("int")).alias("k")).collect()
    ids = [d for d, *_ in rows]
    assert {r.doc_id: r.k for r in pieces} == {d: ids.count(d) for d in ids}
    for _, stage in p.STAGES:
        assert stage(spark, df.where("false"), SF).count() == 0


def test_registration():
    import __spark_entry__ as e
    names = e.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(SQL) <= set(e.oracle_sql())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
