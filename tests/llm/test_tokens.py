"""Encoder, packing, counts and the token matrix against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from flareframe.llm.op1_packing import choose_cuts, pack
from flareframe.llm.op5_token_counts import CACHE, count_tokens
from flareframe.llm.op6_token_output import best_fit, segments, write_matrix
from flareframe.llm.tokens import Encoder
from tokenizers import Tokenizer

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def ids_of(path, texts):
    t = Tokenizer.from_file(path)
    return {d: t.encode(x or "", add_special_tokens=False).ids for d, x in texts}


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_gives_the_librarys_ids(path, odd_docs):
    e, rng = Encoder(path, entries=50), random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\r\n", "\t", "é", "é", "́", "\x1c", "\x85", "\xa0", "'s", "'LL", "12", "!!",
             "<|endoftext|>", "İ", "Σ", "中", "🙂", "\x00", "-", "don't", "ß", "÷", "_", "²"]
    texts = [t for _, t in odd_docs if t] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(800)]
    for t in texts:
        assert e(t) == e.whole(t), repr(t)


def test_cuts_are_cheapest():
    rng = random.Random(2)
    for _ in range(60):
        pos = np.cumsum([0] + [rng.randint(1, 9) for _ in range(rng.randint(1, 40))])
        pen, length = np.array([rng.choice([0.0, 3.0, 7.0]) for _ in pos]), rng.choice([16, 20])

        def cost(i, j):
            n = int(pos[j] - pos[i])
            pad = 0 if n == min(256, length) and n & (n - 1) == 0 else length - n
            return pad + pen[j] + 2 if n <= length else float("inf")
        best = [0.0]
        for j in range(1, len(pos)):
            best.append(min(best[i] + cost(i, j) for i in range(j)))
        cuts = choose_cuts(pos, pen, length, 2.0)
        assert sum(cost(i, j) for i, j in zip(cuts, cuts[1:])) == pytest.approx(best[-1])


@pytest.mark.parametrize("block", [3000, 1 << 20])
def test_packing_keeps_every_id_once(docs, odd_docs, block):
    want = {d: [*v, 1] for d, v in ids_of(WORD, odd_docs).items()}
    rows = pack(docs, WORD, block=block, length=512).collect()
    got, seqs = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.start == len(got.setdefault(r.doc_id, [])) and r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id] += ids
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padding))
    assert got == want
    total = pad = 0
    for parts in seqs.values():
        end = 0
        for o, n, _ in sorted(parts):
            assert o == end
            end += n
        assert end <= 512 and parts[0][2] == (0 if end & (end - 1) == 0 else 512 - end)
        total, pad = total + end, pad + parts[0][2]
    assert pad < 0.05 * total


def test_packing_follows_the_table(spark):
    rows = [(i, "one two three. " * 30) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    at = sorted((r.sequence_id, r.offset, r.doc_id) for r in pack(df, WORD, length=256).collect())
    assert [d for _, _, d in at] == sorted(d for _, _, d in at)


def test_counts_and_cache(spark, docs, odd_docs, tmp_path):
    want = {d: len(v) for d, v in ids_of(BYTE, odd_docs).items()}
    cache = f"{tmp_path}/cache"
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(docs, BYTE, cache).collect()}
        assert got == {d: (len((t or "").encode()), want[d]) for d, t in odd_docs}
        assert spark.read.schema(CACHE).parquet(cache).count() == len({t or "" for _, t in odd_docs})
    spark.createDataFrame([("another version", b"x", 99)], CACHE).write.mode("append").parquet(cache)
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, BYTE, cache).collect()} == want


def test_best_fit_is_tightest():
    rng = random.Random(3)
    for _ in range(100):
        width = rng.randint(1, 40)
        sizes = [rng.randint(1, width) for _ in range(rng.randint(0, 50))]
        rows, room = best_fit(sizes, width), []
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in r) <= width for r in rows)
        for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fits = [(c, k) for k, c in enumerate(room) if c >= sizes[i]]
            if fits:
                room[min(fits)[1]] -= sizes[i]
            else:
                room.append(width - sizes[i])
        assert len(rows) == len(room)


def test_matrix_round_trip(docs, odd_docs, tmp_path):
    want = {d: [*v, 50256] for d, v in ids_of(BYTE, odd_docs).items()}
    m = write_matrix(docs, BYTE, f"{tmp_path}/m", end_id=50256, width=128, pad_id=7, block=4000)
    got = {}
    for r in segments(m, 2).orderBy("doc_id", "start").collect():
        assert r.start == len(got.setdefault(r.doc_id, []))
        got[r.doc_id] += np.frombuffer(r.ids, "<u2").tolist()
    assert got == want
    for r in m.collect():
        assert len(r.input_ids) == 256 and r.cu_seqlens[0] == 0 and r.position_resets == r.cu_seqlens[:-1]
        assert set(np.frombuffer(r.input_ids, "<u2")[r.cu_seqlens[-1]:].tolist()) <= {7}


def test_null_ids_and_empty_tables(spark, no_docs, tmp_path):
    df = spark.createDataFrame([(None, "a b"), (2 ** 62 + 1, "c"), (None, None)], "doc_id long, text string")
    for f in (lambda d, n: pack(d, WORD), lambda d, n: count_tokens(d, BYTE, f"{tmp_path}/c{n}"),
              lambda d, n: segments(write_matrix(d, BYTE, f"{tmp_path}/m{n}", 0), 2)):
        assert sorted((r.doc_id for r in f(df, 1).collect()), key=str) == [2 ** 62 + 1, None, None]
        assert f(no_docs, 2).count() == 0


def test_crc_is_over_little_endian_ids(spark):
    from pyspark.sql import functions as F
    r = pack(spark.createDataFrame([(1, "hello")], "doc_id long, text string"), WORD).withColumn("c", F.crc32("ids")).first()
    ids = ids_of(WORD, [(1, "hello")])[1] + [1]
    assert r.c == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_cache_keeps_what_is_asked_for_again():
    """A full cache does not forget a key that is used all the time, and holds two sets of entries at most."""
    from flareframe.llm.tokens import Cache
    made = []
    cache = Cache(lambda k: made.append(k) or k.encode(), 10)
    for i in range(100):
        assert cache["often"] == b"often" and cache[f"rare{i}"] == f"rare{i}".encode()
        assert len(cache) <= 10 and len(cache.last) <= 10
    assert made.count("often") == 1 and cache["x" * 65] == b"x" * 65 and "x" * 65 not in cache
