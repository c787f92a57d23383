"""Token counts through a cache keyed by the digests of content and tokenizer version."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flareframe.llm.common import given, materialise, texts_of
from flareframe.llm.tokens import encoder

CACHE = "version string, content binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that runs it."""
    import tokenizers
    return hashlib.sha256(Path(path).read_bytes() + tokenizers.__version__.encode()).hexdigest()[:32]


def encode_counts(texts: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """(content, text) to rows of the cache."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            yield pd.DataFrame({"version": version, "content": b["content"],
                                "n_tokens": [len(enc(t)) // 4 for t in b["text"]]})
    return texts.mapInPandas(run, CACHE)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, encoding only contents that the cache does not hold.

    ``cache`` is a folder of Parquet files (version, content, n_tokens) that need not exist.  Contents are keyed
    by SHA-256 of the text as it is (counts depend on every character, so nothing is folded) with a tokenizer
    digest.  The distinct contents that the cache lacks are encoded once each, whatever the number of copies, and
    appended; the answer is then the join of all rows with the cache.  Copies are folded before the shuffle and
    the final join is split by Spark where one content is frequent.  Appending again after a lost task or run may
    repeat a content; repeats carry equal counts and are folded on reading.

    Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows are answered each; null ids stay null; an empty
    table gives no rows and leaves the cache as it is; other columns are not read.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    rows = texts_of(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    keyed = rows.withColumn("content", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)

    def stored() -> DataFrame:
        return (spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
                .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))

    distinct = keyed.groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(stored().select("content"), "content", "left_anti")
    encode_counts(misses.select("content", "text"), tokenizer, version).write.mode("append").parquet(cache)
    lens = keyed.select(given().alias("doc_id"), "content", F.octet_length("text").cast("long").alias("n_bytes"))
    # a plain join of two stored sides, which Spark can split where one content is frequent
    return lens.join(materialise(stored()), "content").select("doc_id", "n_bytes", "n_tokens")
