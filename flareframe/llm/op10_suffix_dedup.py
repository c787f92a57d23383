"""Removing repeated byte strings by hashed content-defined regions, in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flareframe.llm.anchors import OLD, ROW, ROW_NAMES, Alphabet, covered, judged, region_rows, repeated
from flareframe.llm.common import given, materialise, new_folder, remove_folder, runs_of, texts_of, unblob

_SYMBOL = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def byte_symbols(raw: bytes) -> np.ndarray:
    return _SYMBOL[np.frombuffer(raw, np.uint8)]


BYTES = Alphabet(bytes, byte_symbols, bytes)


class SuffixLevels:
    """Tables of hashed regions, in levels of geometrically growing size; no suffix array is built.

    With the two default batches of :func:`drop_repeated_bytes` the family is one table and nothing is merged.

    A suffix is sampled where the least gram of some window stands, about one in forty, so equal windows always
    sample the same places.  An array holds its suffixes sorted by (key: hash of the leading gram, whole: hash of the
    region around it), with the earliest place of each region.  ``add`` sorts a new batch, merge-scans it with every
    level in one pass, and returns its long matches; then the batch's array joins the family, and while the two
    newest levels have the same number of batches they are merged.  ``keep=False`` skips storing the last batch.
    """

    def __init__(self, spark: SparkSession, gram: int, grams: int):
        self.spark, self.gram, self.grams = spark, gram, grams
        self.folder = new_folder(spark, "suffix-levels")
        self.levels: list[tuple[int, str]] = []               # (batches, path), oldest first
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        path, self.made = f"{self.folder}/array-{self.made:06d}", self.made + 1
        rows.select(ROW_NAMES).write.option("compression", "zstd").parquet(path)
        return path

    def _stored(self, path: str) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(path)

    def add(self, texts: DataFrame, keep: bool = True) -> DataFrame:
        """Flagged regions of the batch, and those of older batches that have to be looked at again."""
        rows = region_rows(texts, BYTES, self.gram, self.grams, True)
        for _, path in self.levels:
            rows = rows.unionByName(self._stored(path).withColumn("place", F.col("place").bitwiseOR(F.lit(OLD))))
        out = judged(rows, True).withColumn("old", F.col("place").bitwiseAND(F.lit(OLD)) != 0) \
            .withColumn("place", F.col("place").bitwiseAND(F.lit(~OLD)))
        if keep:                                              # one pass for both answers
            out = materialise(out)
            merge, size = [], 1
            while self.levels and self.levels[-1][0] == size:
                merge.append(self.levels.pop())
                size *= 2
            firsts = out.where("NOT dup AND NOT old")
            for _, path in merge:
                firsts = firsts.select(ROW_NAMES).unionByName(self._stored(path))
            if merge:
                firsts = firsts.repartition("key").sortWithinPartitions("key", "whole")
            self.levels.append((size, self._write(firsts)))
            for _, path in merge:
                remove_folder(self.spark, path)
        return out.where("(dup AND NOT old) OR open").select("id", "t", "place", "dup")


def drop_repeated_bytes(docs: DataFrame, length: int = 100, gram: int = 20, batches: tuple[float, ...] = (0.125, 0.875),
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, spans): bytes in a ``length``-byte string that starts earlier are removed.

    Earlier: in a smaller doc_id, or in the same document at an earlier byte; overlaps count and all strings are
    judged on the input.  Documents enter :class:`SuffixLevels` in batches of rising doc_id, ``batches`` giving
    their shares; the cuts are approximate quantiles and change no result.  Suffixes
    with an equal neighbour region settle all strings of the region; where a suffix's key has other regions, the end
    of a long match is found by comparing the single strings there.  Equal suffixes are folded per task before they
    are shuffled, and texts travel compressed.

    kept is binary, the remaining bytes of the UTF-8 text; spans are [start, end) bytes of the maximal removed runs.
    Null and empty texts are empty.  Equal rows with one id come out equal; different texts with one id are ordered
    by a 64-bit digest; null ids count as one id before all others; an empty table gives no rows; other columns are not
    read.
    """
    spark, texts = docs.sparkSession, texts_of(docs, id_col, text_col)
    levels = SuffixLevels(spark, gram, length - gram + 1)
    at = [float(x) for x in np.cumsum(batches)[:-1] / sum(batches)]
    cuts = texts.agg(F.percentile_approx("id", at).alias("c")).first()["c"] if at else []
    bounds = [None, *sorted(set(cuts or [])), None]
    flagged = []
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = texts
        if low is not None:
            part = part.where(F.col("id") > low)
        if high is not None:
            part = part.where(F.col("id") <= high)
        flagged.append(materialise(levels.add(part, keep=i < len(bounds) - 2)))
    for _, path in levels.levels:
        remove_folder(spark, path)
    rows = flagged[0]
    for f in flagged[1:]:
        rows = rows.unionByName(f)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            out = []
            for doc, z, places in zip(b["id"], b["z"], b["places"]):
                raw = unblob(z)
                gone = covered(len(raw), places, length)
                starts, ends = runs_of(gone)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(starts) else raw
                out.append((doc, kept, len(raw), len(raw) - len(kept), np.stack((starts, ends), 1).tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "kept", "n_bytes", "n_removed", "spans"])
    return repeated(texts, rows, BYTES, gram, length - gram + 1, True).mapInPandas(
        cut, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<array<long>>").withColumn("doc_id", given("doc_id"))
