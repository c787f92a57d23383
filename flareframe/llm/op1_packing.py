"""Order-preserving packing of documents into windows by dynamic programming over their boundaries."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from flareframe.llm.common import given, texts_of
from flareframe.llm.tokens import encoder

SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
          "padding long, ids binary")
DOC, SENTENCE, INSIDE = 0, 1, 2


def choose_cuts(pos: np.ndarray, penalty: np.ndarray, length: int, per_window: float) -> np.ndarray:
    """Indices of the cuts of the cheapest split of ``pos[0]..pos[-1]`` into windows of at most ``length``.

    A window costs its padding (``length`` minus its tokens, none when its size is a power of two), the penalty
    of the cut that ends it and ``per_window``.  best[j] = penalty[j] + min over i of best[i] + length - pos[j] +
    pos[i]: the minimum of best[i] + pos[i] over a sliding range of i, kept in a monotone queue; sizes that are
    powers of two, from 256 on, are looked up by position besides.  Neighbouring positions are at most ``length`` apart.
    """
    n = len(pos)
    exact: dict[int, list[int]] = {}
    size = min(256, length)
    while size <= length:
        at = np.searchsorted(pos, pos - size)
        ok = (at < n) & (pos[np.minimum(at, n - 1)] == pos - size)
        for j in np.flatnonzero(ok).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        size *= 2
    p, pen = pos.tolist(), penalty.tolist()
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(float(p[0]), 0)])
    for j in range(1, n):
        low = p[j] - length
        while p[queue[0][1]] < low:
            queue.popleft()
        cost, i = queue[0]
        cost += length - p[j]
        for k in exact.get(j, ()):
            if best[k] < cost:
                cost, i = best[k], k
        cost += pen[j] + per_window
        best[j], back[j] = cost, i
        key = cost + p[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return np.array(cuts[::-1])


class Stream:
    """Tokens of consecutive documents of one task; hands out windows as soon as later text can't change them."""

    def __init__(self, length: int, penalties: tuple[float, float], grain: int, per_window: float):
        self.length, self.penalties, self.grain, self.per_window = length, penalties, grain, per_window
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int, int]] = []      # id, tokens here, tokens before, tokens in all
        self.ends: list[np.ndarray] = []
        self.size = self.count = 0

    def add(self, doc: int, ids: np.ndarray, sentence: np.ndarray) -> None:
        self.parts.append(ids)
        self.ends.append(sentence)
        self.docs.append((doc, len(ids), 0, len(ids)))
        self.size += len(ids)

    def windows(self, last: bool) -> Iterator[tuple]:
        if not self.size:
            return
        ids, inside = np.concatenate(self.parts), np.concatenate(self.ends)
        stops = np.cumsum([d[1] for d in self.docs])
        kind = np.full(self.size + 1, -1, np.int8)
        kind[1:][inside] = SENTENCE
        kind[0] = kind[stops] = DOC
        pos = np.flatnonzero(kind >= 0)
        gaps = np.flatnonzero(np.diff(pos) > self.grain)     # long stretches without a boundary may be cut inside
        more = [np.arange(pos[g] + self.grain, pos[g + 1], self.grain) for g in gaps]
        if more:
            kind[np.concatenate(more)] = INSIDE
            pos = np.flatnonzero(kind >= 0)
        cost = np.array([0.0, *self.penalties])[kind[pos]]
        cuts = pos[choose_cuts(pos, cost, self.length, self.per_window)]
        if not last:                                         # the end of the buffer still acts on the last windows
            cuts = cuts[:max(2, np.searchsorted(cuts, self.size - 8 * self.length))]
        done = int(cuts[-1])
        starts = stops - [d[1] for d in self.docs]
        edges = np.union1d(cuts, starts[starts < done])
        of, win = np.searchsorted(starts, edges[:-1], "right") - 1, np.searchsorted(cuts, edges[:-1], "right") - 1
        for a, b, d, w in zip(edges[:-1].tolist(), edges[1:].tolist(), of.tolist(), win.tolist()):
            doc, _, before, total = self.docs[d]
            size = int(cuts[w + 1] - cuts[w])
            yield (doc, before + a - int(starts[d]), b - a, total, self.count + w, a - int(cuts[w]),
                   0 if size & (size - 1) == 0 else self.length - size, ids[a:b].tobytes())
        self.count += len(cuts) - 1
        keep = int(np.searchsorted(stops, done, "right"))
        if done == self.size:
            self.parts, self.ends, self.docs = [], [], []
        else:
            doc, size, before, total = self.docs[keep]
            cut = done - int(starts[keep])
            self.docs = [(doc, size - cut, before + cut, total), *self.docs[keep + 1:]]
            self.parts, self.ends = [ids[done:]], [inside[done:]]
        self.size -= done


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, sentence_penalty: float = 16.0,
         inside_penalty: float = 96.0, grain: int = 64, per_window: float = 8.0, block: int = 1 << 20,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents, in the order of the table, into windows of at most ``length`` tokens.

    Each document is its ids by ``tokenizer`` and then ``end_id`` (without ``end_id`` for None).  Windows end at
    document ends for nothing, at sentence ends for ``sentence_penalty`` tokens' worth, and inside a sentence, at
    multiples of ``grain``, for ``inside_penalty``; the split that minimises padding plus penalties is found per
    block of about ``block`` tokens, and a block's last windows are decided again with the next block.  A window
    is padded to ``length`` unless its size is a power of two.  No id is dropped or repeated.

    One row per piece: doc_id, start (ids of the document before it), length, doc_tokens, sequence_id, offset (in
    its window), padding (of its window), ids (little-endian unsigned 32-bit).  Memory is one block and one
    document; there is no shuffle.  Null and empty texts are documents of ``end_id`` alone (of no row without
    it); repeated rows are packed each; an empty table gives no rows; other columns are not read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        enc = encoder(tokenizer)
        ends = np.zeros(enc.tok.get_vocab_size() + 1, bool)
        ends[enc.sentence_ends()] = True
        s = Stream(length, (sentence_penalty, inside_penalty), grain, per_window)
        s.count = TaskContext.get().partitionId() << 36
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        tail = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"]):
                ids = np.frombuffer(enc(text) + tail, dtype="<u4")
                if len(ids):
                    s.add(doc, ids, ends[np.minimum(ids, len(ends) - 1)])
                if s.size >= block:
                    yield pd.DataFrame(s.windows(False), columns=names)
        yield pd.DataFrame(s.windows(True), columns=names)
    return texts_of(docs, id_col, text_col).mapInPandas(run, SCHEMA).withColumn("doc_id", given("doc_id"))
