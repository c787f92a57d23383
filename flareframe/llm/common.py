"""Helpers that several operators share: stored steps, compressed texts, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flareframe.session import folder, materialise, remove, shared_dir

__all__ = ["NO_ID", "blobs", "components", "digest_kept", "given", "materialise", "new_folder", "remove_folder", "shared_dir",
           "runs_of", "texts_of", "unblob"]

NO_ID = -(1 << 63)                                           # stands for a null id


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the folder that all machines share; ``session.scratch`` removes it."""
    return folder(spark, name)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a stored step that nothing reads any more."""
    remove(spark, path)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, as (id bigint, text string); other columns stay out of every shuffle.

    Null ids become ``NO_ID``, so ids reach Python as whole numbers; :func:`given` turns them back.
    """
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.col(text_col).cast("string").alias("text"))


def given(id_col: str = "id") -> Column:
    """The id as it was given: null for ``NO_ID``."""
    return F.when(F.col(id_col) != NO_ID, F.col(id_col))


def blobs(texts: DataFrame) -> DataFrame:
    """(id, text) as (id, z): zstd-compressed UTF-8, for texts that have to travel through a shuffle."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = zstandard.ZstdCompressor(level=5)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "z": [c.compress((t or "").encode()) for t in b["text"]]})
    return texts.mapInPandas(pack, "id long, z binary")


def unblob(z: bytes) -> bytes:
    return zstandard.decompress(z) if z else b""


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a bigint, b bigint) edges: (id, component), component = smallest id reachable.

    Alternating large-star and small-star steps: every node hooks its neighbours to the smallest node it
    sees, so the number of rounds grows with the logarithm of the longest path and no step gathers a
    component in one task.  Each round is a stored table, so lineage stays short and a lost executor costs
    one round at most.  Ends when a round changes nothing; null ends and loops are ignored.
    """
    spark = edges.sparkSession
    cur = materialise(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
                      .distinct())
    if cur.isEmpty():
        return cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    seen = None
    for _ in range(rounds):
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())                               # u > v from here on
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                               F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
                                             .alias("e")).select("e.*").where("u <> v").distinct())
        nxt = materialise(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        cur = nxt
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    heads = cur.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    return cur.select(F.col("v").alias("id"), F.col("u").alias("component")).union(heads)


def digest_kept(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 text."""
    return F.sha2(text.cast("binary"), 256)


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
