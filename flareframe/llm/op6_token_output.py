"""Best-fit-decreasing packing of token ids into a matrix of rows, written as Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flareframe.llm.common import given, texts_of
from flareframe.llm.tokens import encoder

SCHEMA = ("sequence_id long, input_ids binary, cu_seqlens array<int>, position_resets array<int>, "
          "doc_ids array<long>, starts array<long>")


class Capacities:
    """Open rows by the room left in them: a segment tree over 0..width finds the tightest that still fits."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _bump(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._bump(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) with the smallest room of at least ``need``; None if no row has that much."""
        i = need + self.leaves
        while not self.tree[i]:
            while i & 1:                                      # a right child: go up
                i >>= 1
            if i == 0:
                return None
            i += 1                                            # the subtree to the right
            if i & (i - 1) == 0:
                return None
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._bump(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], width: int) -> list[list[int]]:
    """Rows as lists of item numbers: items by falling size, each into the row it fills best."""
    open_rows, out = Capacities(width), []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        room, row = open_rows.take(sizes[i]) or (width, len(out))
        if row == len(out):
            out.append([])
        out[row].append(i)
        if room - sizes[i]:
            open_rows.put(room - sizes[i], row)
    return out


def write_matrix(docs: DataFrame, tokenizer: str, path: str, end_id: int, width: int = 2048, pad_id: int = 0,
                 block: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write documents as rows of ``width`` token ids to Parquet at ``path`` and return the table read back.

    A document is its ids and ``end_id``; one longer than ``width`` is split into full pieces and a rest, so no
    id is lost.  Pieces of about ``block`` tokens of a task at a time go best-fit decreasing into rows.  Columns:
    sequence_id; input_ids (``width`` little-endian unsigned ids, 16-bit where the vocabulary allows, filled up
    with ``pad_id``); cu_seqlens (0 and the end of every piece); position_resets (where positions start from 0
    again: every piece's begin); doc_ids and starts (of each piece in its document;
    a null id is the least 64-bit number there).  Memory is one block and one
    document; no shuffle.  Null and empty texts are ``end_id`` alone; repeated rows are written each; an empty
    table writes no rows; other columns are not read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        enc = encoder(tokenizer)
        dtype = "<u2" if max(enc.tok.get_vocab_size(), pad_id + 1, end_id + 1) <= 1 << 16 else "<u4"
        number, pieces, held = TaskContext.get().partitionId() << 36, [], 0

        def rows() -> pd.DataFrame:
            nonlocal number
            packed = best_fit([len(p[2]) for p in pieces], width)
            out = []
            for row in packed:
                m, cu = np.full(width, pad_id, dtype), [0]
                for k in row:
                    m[cu[-1]:cu[-1] + len(pieces[k][2])] = pieces[k][2]
                    cu.append(cu[-1] + len(pieces[k][2]))
                out.append((number, m.tobytes(), cu, cu[:-1], [pieces[k][0] for k in row],
                            [pieces[k][1] for k in row]))
                number += 1
            return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"]):
                ids = np.append(np.frombuffer(enc(text), "<u4"), np.uint32(end_id)).astype(dtype)
                pieces += [(doc, a, ids[a:a + width]) for a in range(0, len(ids), width)]
                held += len(ids)
                if held >= block:
                    yield rows()
                    pieces, held = [], 0
        if pieces:
            yield rows()
    (texts_of(docs, id_col, text_col).mapInPandas(run, SCHEMA)
     .write.option("compression", "zstd").parquet(path))
    return docs.sparkSession.read.schema(SCHEMA).parquet(path)


def segments(matrix: DataFrame, id_bytes: int) -> DataFrame:
    """One row per piece of a written matrix: doc_id, start, length, sequence_id, offset, ids (as stored)."""
    at = matrix.select("sequence_id", "input_ids", "cu_seqlens", "starts", F.posexplode("doc_ids").alias("k", "doc_id")).withColumn("doc_id", given("doc_id"))
    begin, end = F.expr("cu_seqlens[k]"), F.expr("cu_seqlens[k + 1]")
    return at.select("doc_id", F.expr("starts[k]").alias("start"), (end - begin).cast("long").alias("length"),
                     "sequence_id", begin.cast("long").alias("offset"),
                     F.substring("input_ids", begin * id_bytes + 1, (end - begin) * id_bytes).alias("ids"))
