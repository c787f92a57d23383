"""Removing passages that stand in earlier documents, by hashed content-defined regions of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from flareframe.llm.anchors import Alphabet, covered, judged, region_rows, repeated
from flareframe.llm.common import given, materialise, runs_of, texts_of, unblob


def word_symbols(raw: bytes) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, raw.split()), np.uint64)


WORDS = Alphabet(bytes.split, word_symbols, b" ".join)


def drop_repeats(docs: DataFrame, window: int = 13, seed: int = 4, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed, spans): words covered by a window that a smaller doc_id has are removed.

    Every document is cut where the content says (regions of :mod:`anchors` on ``seed``-word grams), and regions with
    an equal hash are repeated as wholes.  Where a region's key has other regions, too, finer regions and then single
    windows are compared with those of all such places, so spans end at the exact word.  Nothing is parsed into
    Lempel-Ziv phrases or factors.  ``window - seed + 1`` grams make a window.

    Words are separated by ASCII white space and compared byte by byte; spans are [start, end) word numbers; text is
    the kept words joined by one space.  Null and empty texts have no words and come back empty.  Rows that share a
    doc_id, told apart by a 64-bit digest of their texts, are never duplicates of each other; null ids count as one id before all others; an empty table gives no
    rows; other columns are not read.  A worker holds one Arrow batch of compressed texts and one text at a time in full.
    """
    texts, w = texts_of(docs, id_col, text_col), window - seed + 1
    flagged = materialise(judged(region_rows(texts, WORDS, seed, w, False), False).where("dup OR open").select("id", "t", "place", "dup"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, z, places in zip(b["id"], b["z"], b["places"]):
                raw = unblob(z)
                words = raw.split()
                gone = covered(len(words), places, window)
                starts, ends = runs_of(gone)
                kept = [x for x, g in zip(words, gone.tolist()) if not g] if len(starts) else words
                out.append((doc, b" ".join(kept).decode(), len(words), len(words) - len(kept),
                            np.stack((starts, ends), 1).tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "text", "n_words", "n_removed", "spans"])
    return repeated(texts, flagged, WORDS, seed, w, False).mapInPandas(
        cut, "doc_id long, text string, n_words long, n_removed long, spans array<array<long>>").withColumn("doc_id", given("doc_id"))
