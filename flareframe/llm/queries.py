"""The operators over the given tables with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flareframe.llm.common import digest_kept, new_folder
from flareframe.llm.op10_suffix_dedup import drop_repeated_bytes
from flareframe.llm.op11_alignment import align
from flareframe.llm.op12_collocations import collocations
from flareframe.llm.op13_secret_scans import RULES, scan_secrets
from flareframe.llm.op1_packing import pack
from flareframe.llm.op2_quality import fit_quality, score_quality
from flareframe.llm.op3_line_dedup import drop_lines
from flareframe.llm.op4_decontamination import contamination
from flareframe.llm.op5_token_counts import count_tokens
from flareframe.llm.op6_token_output import segments, write_matrix
from flareframe.llm.op7_jaccard_join import similar_documents
from flareframe.llm.op8_substring_dedup import drop_repeats
from flareframe.llm.op9_embedding_dedup import near_vectors
from flareframe.llm.sql import SQL


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pack(docs_of(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)
    return got.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = score_quality(docs, fit_quality(docs, labels.where(~held_out())))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drop_lines(docs_of(spark, sf_dir), min_docs=10, min_chars=1)
    return got.select("doc_id", "n_lines", "n_dropped", digest_kept(F.col("text")).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination(docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, share=20)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      digest_kept(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = count_tokens(docs_of(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                       new_folder(spark, "token-cache"))
    return got.withColumn("over_limit", F.col("n_tokens") > 512)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = write_matrix(docs_of(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                       new_folder(spark, "token-matrix"), end_id=50256, width=2048, pad_id=50256)
    return segments(got, 2).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(docs_of(spark, sf_dir), k=3, percent=90)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drop_repeats(docs_of(spark, sf_dir), window=13)
    return got.select("doc_id", "n_words", "n_removed", digest_kept(F.col("text")).alias("kept_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9)
    return got.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drop_repeated_bytes(docs_of(spark, sf_dir), length=100)
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      digest_kept(F.col("kept")).alias("kept_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = align(docs_of(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                public_tokenizers.path("piece_bpe_32k.model"), keep=lambda groups: F.when(groups != "", F.sha2(groups, 256)))
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.coalesce("groups", F.lit("")).alias("groups_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(docs_of(spark, sf_dir), least=30, longest=4, top=2000)


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan_secrets(docs_of(spark, sf_dir))
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(r.kind) for r in RULES]
    return got.select("doc_id", *counts, F.sha2(said, 256).alias("base_sha256"), said.alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_token_output": op6_token_output,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_alignment": op11_alignment,
    "op12_collocations": op12_collocations,
    "op13_secret_scans": op13_secret_scans,
}

__all__ = ["QUERIES", "SQL"]
