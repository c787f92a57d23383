"""Line, passage and byte-string deduplication against direct computation."""

import hashlib
import random
from collections import Counter

import xxhash
from conftest_llm import brute_bytes, brute_lines, brute_words
from flareframe.llm.op3_line_dedup import LineRuns, drop_lines
from flareframe.llm.op8_substring_dedup import drop_repeats
from flareframe.llm.op10_suffix_dedup import drop_repeated_bytes


def test_lines(docs, odd_docs):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in drop_lines(docs, min_docs=10).collect()}
    assert got == brute_lines(odd_docs, 10)
    assert sum(v[1] for v in got.values()) > 20


def test_lines_do_not_depend_on_batches(docs):
    a = sorted(drop_lines(docs, min_docs=3, batches=1).collect(), key=str)
    assert a == sorted(drop_lines(docs, min_docs=3, batches=7, fanout=2).collect(), key=str)


def test_runs_merge_and_settle(spark):
    runs = LineRuns(spark, f"/tmp/flareframe-runs-{random.random()}", min_docs=3, fanout=2)
    for _ in range(5):
        runs.add(spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "key binary"))
    assert sum(map(len, runs.levels)) <= 3
    got = {bytes(r.key): r.n_docs for r in runs.counts().collect()}
    assert got == {b"a": 4, b"b": 3}                          # settled keys are not counted on
    assert {bytes(r.key) for r in runs.frequent().collect()} == {b"a", b"b"}


def test_words(docs, odd_docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in drop_repeats(docs, 13).collect()}
    want = brute_words(odd_docs, 13)
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert sum(v[1] for v in got.values()) > 1000


def test_words_other_sizes(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for window, seed in ((6, 2), (5, 3), (9, 4)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in drop_repeats(df, window, seed).collect()}
        assert got == brute_words(rows, window)


def test_bytes(docs, odd_docs):
    for batches in ((1,), (0.125, 0.875), (1, 1, 1, 1)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())
               for r in drop_repeated_bytes(docs, 100, batches=batches).collect()}
        want = brute_bytes(odd_docs, 100)
        assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {}
    assert sum(v[1] for v in got.values()) > 10000


def test_bytes_other_sizes(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(40)]
    rows += [(100 + i, "ab" * 60 + "a" * i) for i in range(5)] + [(200, "a" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for length, gram in ((14, 6), (11, 4), (20, 9)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())
               for r in drop_repeated_bytes(df, length, gram, batches=(1, 1, 2)).collect()}
        assert got == brute_bytes(rows, length)


def test_repeated_ids_null_ids_and_empty_tables(spark, no_docs):
    p = " ".join(f"p{i}" for i in range(40))
    df = spark.createDataFrame([(1, p), (1, p), (1, "x " + p + " y"), (None, p), (2, p)], "doc_id long, text string")
    words = sorted(((r.doc_id, r.n_removed) for r in drop_repeats(df).collect()), key=str)
    assert words == [(1, 40), (1, 40), (1, 40), (2, 40), (None, 0)]
    assert drop_repeated_bytes(df).count() == 5 and drop_lines(df, 2).count() == 5
    for f in (drop_lines, drop_repeats, drop_repeated_bytes):
        assert f(no_docs).count() == 0


def test_many_texts_under_one_id(spark):
    """More texts under one id, and under null, than a short tag could tell apart, and copies among them."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    rows = [(1, " ".join(passage))]
    for i in range(1500):
        t = [f"u{i}x{j}" for j in range(rng.randint(20, 60))]
        at = rng.randint(0, len(t))
        rows.append((5 if i % 3 else None, " ".join(t[:at] + passage[:rng.randint(14, 30)] + t[at:])))
    rows += rows[1:40]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    rank = {r: i for i, r in enumerate(sorted(set(rows), key=lambda r: (
        r[0] is not None, r[0] or 0, (xxhash.xxh64_intdigest(r[1]) + (1 << 63)) % (1 << 64))))}
    order = sorted(rank, key=rank.get)
    first = {}
    for d, t in order:                                        # the null id is before all others
        w = t.split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i:i + 13]), d)
    want = Counter()
    for d, t in rows:
        w, gone = t.split(), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i:i + 13])] != d:
                gone.update(range(i, i + 13))
        want[d, " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    got = Counter((r.doc_id, r.text) for r in drop_repeats(df).collect())
    assert got == want
    cut = brute_bytes([(rank[r], r[1]) for r in rank], 60)
    want = Counter((d, *cut[rank[d, t]]) for d, t in rows)
    for batches in ((1,), (0.125, 0.875), (1, 1, 1)):
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())
                      for r in drop_repeated_bytes(df, 60, batches=batches).collect())
        assert got == want
