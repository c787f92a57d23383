"""Content-defined regions of symbol sequences, and the exact search for repeated windows through them.

A window is ``w + k - 1`` consecutive symbols, that is ``w`` consecutive ``k``-grams.  Its key is the least gram
hash in it, so equal windows have equal keys wherever they stand.  Consecutive windows with one key form a region.
Two regions that are equal as wholes settle all their windows at once; a region whose key also belongs to a
different region is open.  The symbols of open regions are cut out once, split again by longer grams and judged in the
same way; of what is open then, single windows are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flareframe.llm.common import materialise, unblob

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
_R, _RI = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for i, r in enumerate((_R, _RI)):
            p = np.full(m, U(r), U)
            p[0] = U(1)
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + b * _B
    x ^= x >> U(29)
    x *= _C
    x ^= x >> U(32)
    return x


def grams(s: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` symbols from each position, by joining hashes of half the width."""
    widths, size, out = {}, 1, s
    while size <= k:
        widths[size] = out
        if size * 2 <= k:
            out = _join(out[:-size], out[size:])
        size *= 2
    have = max(widths)
    got = widths[have]
    for size in sorted(widths, reverse=True)[1:]:
        if (k - have) & size:
            n = len(s) - have - size + 1
            got, have = _join(got[:n], widths[size][have:have + n]), have + size
    return got


def _slide(a: np.ndarray, w: int, op: Callable) -> np.ndarray:
    size, out = 1, a
    while size * 2 <= w:
        out = op(out[:-size], out[size:])
        size *= 2
    return out if size == w else op(out[:len(a) - w + 1], out[w - size:w - size + len(a) - w + 1])


class Regions:
    """Regions of one sequence: ``lo`` (first window), ``n`` (windows), ``key``, ``whole`` (hash), ``loose``.

    ``only``: (starts, counts) of disjoint rising ranges of windows; the others are left out and regions end there.
    """

    def __init__(self, s: np.ndarray, k: int, w: int, only: tuple[np.ndarray, np.ndarray] | None = None):
        self.w = w
        self.least = np.empty(0, U)
        if len(s) < k + w - 1:
            self.lo = self.n = np.empty(0, np.int64)
            self.key = self.whole = self.least
            self.loose = np.empty(0, bool)
            return
        h = grams(s, k)
        self.least = _slide(h, w, np.minimum)
        cut = np.flatnonzero(self.least[1:] != self.least[:-1]) + 1
        if only is None:
            lo = np.concatenate(([0], cut))
            n = np.diff(np.concatenate((lo, [len(self.least)])))
        else:
            starts, ends = only[0], only[0] + only[1]
            lo = np.union1d(np.concatenate(([0], cut)), np.concatenate((starts, ends)))
            lo = lo[lo < len(self.least)]
            n = np.diff(np.concatenate((lo, [len(self.least)])))
            at = np.searchsorted(starts, lo, "right") - 1
            inside = (at >= 0) & (lo < ends[np.maximum(at, 0)])
            lo, n = lo[inside], n[inside]
        key = self.least[lo]
        # a least gram that stands twice in a region: its windows may repeat inside it
        high = _slide(np.concatenate((np.zeros(w - 1, U), self.least, np.zeros(w - 1, U))), w, np.maximum)
        at = np.flatnonzero(high == h)
        v = h[at]
        loose = np.isin(key, v[1:][(v[1:] == v[:-1]) & (np.diff(at) < 2 * w)])
        if (n > w).any():                                     # only ties make such runs; cut them to at most w windows
            parts = -(-n // w)
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            ends = np.repeat(lo + n, parts)
            lo = np.repeat(lo, parts) + step * w
            n = np.minimum(w, ends - lo)
            key, loose = np.repeat(key, parts), np.repeat(loose, parts)
        p, self._inv = _power(len(h))
        self._sum = np.concatenate((np.zeros(1, U), np.cumsum(h * p, dtype=U)))
        self.lo, self.n, self.key, self.loose = lo, n, key, loose
        self.whole = ((self._sum[lo + n - 1 + w] - self._sum[lo]) * self._inv[lo]) * _A + n.astype(U)

    def windows(self, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, hash) of single windows."""
        return self.least[j], (self._sum[j + self.w] - self._sum[j]) * self._inv[j]


@dataclass(frozen=True)
class Alphabet:
    """How a text is a sequence: its pieces, their symbols, and how to write pieces so that they read the same."""

    pieces: Callable[[bytes], Sequence]
    symbols: Callable[[bytes], np.ndarray]
    write: Callable[[Sequence], bytes]


# A text is known by its id and ``t``, a 64-bit digest: rows that share an id but not a text stay apart.  A place packs
# the first window, the number of windows, and flags, so places of one text are ordered as the text is.
_LO, LOOSE, KNOWN, OLD = 11, 4, 2, 1


def digest_of(raw: bytes) -> int:
    d = xxhash.xxh64_intdigest(raw)
    return d - (d >> 63 << 64)


def place_of(lo: np.ndarray, n: np.ndarray, loose: np.ndarray | int = 0) -> np.ndarray:
    return (lo << _LO) | ((n - 1) << 3) | loose * LOOSE


def unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows)."""
    place = np.asarray(place, np.int64)
    return place >> _LO, ((place >> 3) & 255) + 1


def packed(texts: DataFrame) -> DataFrame:
    """(id, text) as (id, t, z), z as :func:`common.blobs` makes it."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = zstandard.ZstdCompressor(level=5)
        for b in batches:
            raws = [(t or "").encode() for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "t": np.array([digest_of(r) for r in raws], np.int64),
                                "z": [c.compress(r) for r in raws]})
    return texts.mapInPandas(pack, "id long, t long, z binary")


def _fold(cols: dict[str, np.ndarray], same_doc: bool) -> pd.DataFrame:
    """Flag rows that have an equal, earlier row in this batch as known and give them a key of their own.

    Equal regions of a batch so reach the shuffle as one row under their key; no group of copies lands in one task.
    """
    key, whole, ids, text, place = cols["key"], cols["whole"], cols["id"], cols["t"], cols["place"]
    o = np.lexsort((place, text, ids, whole, key))
    k, w, i, t, p = key[o], whole[o], ids[o], text[o], place[o]
    start = np.concatenate(([True], (k[1:] != k[:-1]) | (w[1:] != w[:-1]))) if len(o) else np.empty(0, bool)
    head = np.maximum.accumulate(np.where(start, np.arange(len(o)), 0))
    known = i > i[head]
    if same_doc:
        known |= (i == i[head]) & ((t > t[head]) | (t == t[head]) & (p > p[head]))
    own = o[known]
    key[own] = (ids[own].view(U) * _B + text[own].view(U) * _A + place[own].view(U) * _C).view(np.int64)
    place[own] |= KNOWN
    return pd.DataFrame(cols)


def _tables(parts: Iterator[dict[str, np.ndarray]], same_doc: bool, names: list[str]) -> Iterator[pd.DataFrame]:
    """Small column sets gathered to folded tables of bounded size."""
    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p["id"])
        if size > 400_000:
            yield _fold({c: np.concatenate([h[c] for h in held]) for c in names}, same_doc)
            held, size = [], 0
    if held:
        yield _fold({c: np.concatenate([h[c] for h in held]) for c in names}, same_doc)


ROW = "id long, t long, place long, key long, whole long"
ROW_NAMES = ["id", "t", "place", "key", "whole"]


def region_rows(texts: DataFrame, alphabet: Alphabet, k: int, w: int, same_doc: bool) -> DataFrame:
    """(id, text) to one row per region: id, t, place, key, whole."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts() -> Iterator[dict[str, np.ndarray]]:
            for b in batches:
                for doc, text in zip(b["id"], b["text"]):
                    raw = (text or "").encode()
                    r = Regions(alphabet.symbols(raw), k, w)
                    if len(r.lo):
                        yield {"id": np.full(len(r.lo), doc, np.int64), "t": np.full(len(r.lo), digest_of(raw), np.int64),
                               "place": place_of(r.lo, r.n, r.loose), "key": r.key.view(np.int64), "whole": r.whole.view(np.int64)}
        yield from _tables(parts(), same_doc, ROW_NAMES)
    return texts.mapInPandas(run, ROW)


def judged(rows: DataFrame, same_doc: bool) -> DataFrame:
    """Region rows with ``dup`` (an earlier equal region settles it) and ``open`` (its key has other regions, too).

    One shuffle and one sort by (key, whole).
    """
    same, all_ = Window.partitionBy("key", "whole"), Window.partitionBy("key")
    order = F.struct("id", "t", F.shiftright("place", _LO).alias("at")) if same_doc else F.col("id")
    out = (rows.withColumn("first", F.min(order).over(same))
           .withColumn("many", F.min("whole").over(all_) != F.max("whole").over(all_)))
    flag = F.col("place").bitwiseAND
    return (out.withColumn("dup", (flag(F.lit(KNOWN)) != 0) | (F.col("first") < order))
            .withColumn("open", ~F.col("dup") & (F.col("many") | (flag(F.lit(LOOSE)) != 0))).drop("first", "many"))


def _cut_out(texts: DataFrame, open_: DataFrame, alphabet: Alphabet, span: int) -> DataFrame:
    """(id, t, place, raw): the symbols of every open region; texts travel compressed."""
    wanted = open_.groupBy("id", "t").agg(F.collect_set("place").alias("places"))
    rows = packed(texts).join(wanted, ["id", "t"]).select("id", "t", "z", "places")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, t, z, places in zip(b["id"], b["t"], b["z"], b["places"]):
                pieces = alphabet.pieces(unblob(z))
                for place, lo, n in zip(places.tolist(), *(x.tolist() for x in unplace(places))):
                    out.append((doc, t, place, alphabet.write(pieces[lo:lo + n - 1 + span])))
            yield pd.DataFrame(out, columns=["id", "t", "place", "raw"])
    return rows.mapInPandas(run, "id long, t long, place long, raw binary")


def _strung(b: pd.DataFrame, alphabet: Alphabet, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a batch of cut-outs with a symbol of no text between them, and where each begins."""
    parts, at, here = [], [], 0
    for raw in b["raw"]:
        s = alphabet.symbols(raw)
        at.append(here)
        parts += [s, np.array([xxhash.xxh64_intdigest(here.to_bytes(8, "little"), seed=5)], U)]
        here += len(s) + 1
    return np.concatenate(parts), np.array(at, np.int64)


def _slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i:i + rows]


def _finer(cuts: DataFrame, alphabet: Alphabet, k: int, w: int, span: int, same_doc: bool) -> DataFrame:
    """Regions of the cut-outs by ``k``-grams: region rows with the ``parent`` place."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts() -> Iterator[dict[str, np.ndarray]]:
            for b in _slices(batches):
                ids, parent = b["id"].to_numpy(), b["place"].to_numpy()
                lo, n = unplace(parent)
                s, at = _strung(b, alphabet, span)
                r = Regions(s, k, w, (at, n))
                of = np.searchsorted(at, r.lo, "right") - 1
                yield {"id": ids[of], "t": b["t"].to_numpy()[of], "place": place_of(lo[of] + r.lo - at[of], r.n, r.loose),
                       "key": r.key.view(np.int64), "whole": r.whole.view(np.int64), "parent": parent[of]}
        yield from _tables(parts(), same_doc, [*ROW_NAMES, "parent"])
    return cuts.mapInPandas(run, ROW + ", parent long")


def _single(cuts: DataFrame, open_: DataFrame, alphabet: Alphabet, k: int, w: int, span: int, same_doc: bool) -> DataFrame:
    """Region rows for every window of the open finer regions."""
    wanted = open_.groupBy("id", "t", "parent").agg(F.collect_set("place").alias("parts"))
    rows = cuts.join(wanted.withColumnRenamed("parent", "place"), ["id", "t", "place"]).select("id", "t", "place", "raw", "parts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts() -> Iterator[dict[str, np.ndarray]]:
            for b in _slices(batches):
                s, at = _strung(b, alphabet, span)
                r = Regions(s, k, w)
                many = b["parts"].map(len).to_numpy()
                of = np.repeat(np.arange(len(b)), many)
                lo, n = unplace(np.concatenate(b["parts"].to_numpy()))
                first, _ = unplace(b["place"].to_numpy())
                begin = at[of] + lo - first[of]
                j = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                of = np.repeat(of, n)
                key, whole = r.windows(j)
                yield {"id": b["id"].to_numpy()[of], "t": b["t"].to_numpy()[of],
                       "place": place_of(first[of] + j - at[of], np.ones(len(j), np.int64)),
                       "key": key.view(np.int64), "whole": whole.view(np.int64)}
        yield from _tables(parts(), same_doc, ROW_NAMES)
    return rows.mapInPandas(run, ROW)


def repeated(texts: DataFrame, flagged: DataFrame, alphabet: Alphabet, k: int, w: int, same_doc: bool) -> DataFrame:
    """(id, z, places): every text, compressed, with its runs of repeated windows (null where it has none).

    ``flagged``: (id, t, place, dup) of the regions that are settled as repeated or open, a stored table.
    """
    span, w2 = k + w - 1, min(w, max(3, w // 9))
    k2 = span - w2 + 1
    cuts = materialise(_cut_out(texts, flagged.where("NOT dup"), alphabet, span))
    finer = materialise(judged(_finer(cuts, alphabet, k2, w2, span, same_doc), same_doc).where("dup OR open")
                        .select("id", "t", "place", "parent", "dup"))
    single = judged(_single(cuts, finer.where("NOT dup"), alphabet, k2, w2, span, same_doc), same_doc).where("dup")
    one = ["id", "t", "place"]
    runs = flagged.where("dup").select(one).union(finer.where("dup").select(one)).union(single.select(one))
    found = runs.groupBy("id", "t").agg(F.collect_set("place").alias("places"))   # equal rows of one id give theirs once
    return packed(texts).join(found, ["id", "t"], "left").select("id", "z", "places")


def covered(size: int, places: np.ndarray | None, span: int) -> np.ndarray:
    """Mask of the symbols of a text that lie in a repeated window of ``span`` symbols."""
    edge = np.zeros(size + 1, np.int64)
    if places is not None and len(places):
        at, n = unplace(places)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n - 1 + span, -1)
    return np.cumsum(edge[:-1]) > 0
