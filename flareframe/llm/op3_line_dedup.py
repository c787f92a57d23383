"""Dropping lines that many documents share, with levelled sorted runs of line digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flareframe.llm.common import NO_ID, given, new_folder, remove_folder, texts_of

# What counts as white space at the ends of a line.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANK)), UPPER, LOWER)


class LineRuns:
    """Levels of sorted runs (key, n_docs): sixteen-byte line digests and the documents they were counted in.

    ``add`` counts a batch's keys, merge-anti-joins them with the keys that the stored runs have already settled
    (found in ``min_docs`` documents or more; more counts change nothing), and stores the rest as a run of its
    own.  When a level holds ``fanout`` runs they are merged into one run of the next level, so each key is
    rewritten a logarithmic number of times.  Runs are hash-partitioned and sorted by key.
    """

    def __init__(self, spark: SparkSession, folder: str, min_docs: int, fanout: int = 3):
        self.spark, self.folder, self.min_docs, self.fanout = spark, folder, min_docs, fanout
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def _write(self, run: DataFrame) -> str:
        path, self.made = f"{self.folder}/run-{self.made:06d}", self.made + 1
        run.repartition("key").sortWithinPartitions("key").write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("key binary, n_docs long").parquet(*paths)

    def counts(self, paths: list[str] | None = None) -> DataFrame:
        paths = [p for level in self.levels for p in level] if paths is None else paths
        if not paths:
            return self.spark.createDataFrame([], "key binary, n_docs long")
        return self._read(paths).groupBy("key").agg(F.sum("n_docs").alias("n_docs"))

    def frequent(self) -> DataFrame:
        return self.counts().where(F.col("n_docs") >= self.min_docs).select("key")

    def add(self, keys: DataFrame) -> None:
        """``keys``: (key) once for each document of the batch that has it."""
        batch = keys.groupBy("key").agg(F.count("*").alias("n_docs"))
        if any(self.levels):
            batch = batch.join(self.frequent(), "key", "left_anti")
        self.levels[0].append(self._write(batch))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self.counts(old)))
            for path in old:
                remove_folder(self.spark, path)
            level += 1


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3,
               id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every text without the lines that ``min_docs`` or more documents have.

    A line's key is the line with white space stripped at both ends and A-Z lower-cased; keys shorter than
    ``min_chars`` characters are never dropped.  Documents go through :class:`LineRuns` in ``batches`` batches by a
    hash of their id; the runs at the end hold the counts over all documents, and texts are cut after that, so the
    result does not depend on the batches.  Keys are folded per document and per task before each shuffle; the
    join of keys with frequent keys is split by Spark where one line is frequent.

    Null and empty texts are one empty line, and come back as the empty text.  Rows with the same id count as one
    document and are cut each, and so do rows with null ids; an empty table gives no rows; other columns
    are not read.  ``row_col``: a unique, stored number of the row, returned as ``row``; the lines to drop then go to
    rows, not to ids.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "line-runs")
    rows, own = texts_of(docs, id_col, text_col), ["id"]
    if row_col is not None:
        own = ["id", "row"]
        rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                           F.col(text_col).cast("string").alias("text"), F.col(row_col).cast("long").alias("row"))
    at = own[-1]
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    keys = F.filter(F.transform(F.split("text", "\n", -1), line_key), lambda k: F.char_length(k) >= min_chars)
    hashed = rows.select(*own, F.explode(F.array_distinct(F.transform(keys, lambda k: F.unhex(F.md5(k.cast("binary"))))))
                         .alias("key"))
    hashed.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")) \
        .write.partitionBy("batch").parquet(f"{folder}/keys")
    stored = spark.read.schema(", ".join([*(f"{c} long" for c in own), "key binary, batch int"])).parquet(f"{folder}/keys")
    runs = LineRuns(spark, folder, min_docs, fanout)
    for b in range(batches):
        runs.add(stored.where(F.col("batch") == b).select("id", "key").distinct().select("key"))
    runs.frequent().write.parquet(f"{folder}/frequent")
    frequent = spark.read.schema("key binary").parquet(f"{folder}/frequent")
    hits = stored.join(frequent, "key").groupBy(at).agg(F.collect_set("key").alias("drop")) \
        .withColumnRenamed(at, "hit")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for *of, text, drop in zip(*(p[c] for c in own), p["text"], p["drop"]):
                lines = text.split("\n")
                if drop is None:
                    out.append((*of, text, len(lines), 0))
                    continue
                gone = {bytes(k) for k in drop}
                kept = [x for x in lines if hashlib.md5(x.strip(BLANK).translate(TO_LOWER).encode(),
                                                        usedforsecurity=False).digest() not in gone]
                out.append((*of, "\n".join(kept), len(lines), len(lines) - len(kept)))
            yield pd.DataFrame(out, columns=[*names, "text", "n_lines", "n_dropped"])
    names = ["doc_id", *own[1:]]
    joined = rows.join(hits, F.col(at) == F.col("hit"), "left").select(*own, "text", "drop")
    schema = ", ".join([*(f"{c} long" for c in names), "text string, n_lines long, n_dropped long"])
    return joined.mapInPandas(cut, schema).withColumn("doc_id", given("doc_id"))
