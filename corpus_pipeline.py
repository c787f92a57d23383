"""From raw documents to packed windows: quality, shared lines, near duplicates, benchmark passages, packing.

Each stage works on everything that the one before kept and is written as Parquet and read again.  A stage decides on
rows, not on ids: rows with null ids and rows that share an id are judged one by one, and each keeps its own columns.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from flareframe.llm.common import materialise, new_folder
from flareframe.llm.op1_packing import pack
from flareframe.llm.op2_quality import STATS, fit_quality, stats_of
from flareframe.llm.op3_line_dedup import drop_lines
from flareframe.llm.op4_decontamination import contamination
from flareframe.llm.op7_jaccard_join import similar_documents
from flareframe.session import noted, remove, scratch

#: Documents below this score are rejected.
MIN_QUALITY = 0.5


def unused(name: str, docs: DataFrame) -> str:
    """``name``, with as many underscores as no column of ``docs`` has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, stored once so that it is the same whenever it is read; its column."""
    row, path = unused("row", docs), new_folder(spark, "numbered")
    out = docs.withColumn(row, F.monotonically_increasing_id())
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path), row


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rule ensemble, fitted on the labels, does not reject.

    Every row is scored by its own text, whatever its id, where it stands: there is no join.  Null and empty texts
    are scored as the empty text; an empty table gives no rows.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    stats = [unused(s, docs) for s in STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [stats_of(t) for t in b.column(names.index("text")).to_pylist()]
            own = [pa.array([r[i] for r in x], pa.float64()) for i in range(len(stats))]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*names, *stats])
    names, schema = docs.columns, StructType([*docs.schema.fields, *(StructField(s, DoubleType()) for s in stats)])
    scored = docs.mapInArrow(run, schema)
    return scored.where(model.score(dict(zip(STATS, stats))) >= MIN_QUALITY).select(*names)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more have; n_chars follows the text.

    All rows stay, each with its own text and columns.  Rows that share an id count as one document, and so do all
    rows with null ids.  Null texts become empty; an empty table gives no rows.
    """
    rows, row = numbered(spark, docs)
    cut = drop_lines(rows, min_docs=10, row_col=row).select("row", "text").withColumnRenamed("row", row)
    return rows.drop("text", "n_chars").join(cut, row).select(
        *[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near duplicates (five words, similarity 0.8).

    Of rows that share the smallest id one stays; a null id is the largest.  Texts without words, null and empty ones
    too, are near nothing and all stay; an empty table gives no rows.
    """
    rows, row = numbered(spark, docs)
    groups = materialise(similar_documents(rows, k=5, percent=80, id_col=row).where("n_shingles > 0")
                         .select(F.col("doc_id").alias("r"), F.col("component_id").alias("g")))
    several = groups.where("r <> g").select("g").distinct()
    grouped = groups.join(several, "g").join(rows.select(F.col(row).alias("r"), F.col("doc_id").alias("d")), "r")
    best = grouped.groupBy("g").agg(F.min(F.struct(F.col("d").isNull().alias("n"), "d", "r")).alias("m")) \
        .select("g", F.col("m.r").alias("head"))
    gone = groups.join(best, "g").where("r <> head").select(F.col("r").alias(row))
    return rows.join(materialise(gone), row, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a contaminating share of benchmark passages.

    Every row is judged by its own text, whatever its id.  Null and empty texts stay; an empty table gives no rows.
    """
    rows, row = numbered(spark, docs)
    bad = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row, unique=True).where("contaminated")
    return rows.join(bad.select(F.col("doc_id").alias(row)), row, "left_anti").select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 2048 tokens, as the packing query gives them.

    Every row is packed by itself, also with a null or repeated id; null and empty texts are the end token alone; an
    empty table gives no rows.
    """
    got = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)
    return got.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


_left: list[str] = []                                        # folders of steps that the stage before has stored


def tidy(stage):
    """The stage, which first removes what the stage before has stored: its result is written by now.

    Nothing is removed while ``docs`` still reads from those folders.
    """
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left and not any(f.split("/")[-1] in path for f in _left for path in docs.inputFiles()):
            while _left:
                remove(spark, _left.pop())
        with noted(_left):
            return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, tidy(stage)) for name, stage in (
    ("quality classifier", keep_good), ("line dedup", drop_shared_lines), ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated), ("packing", pack_windows))]

ORACLE_SQL = None                                            # tested against the stages run one by one


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder and read by the next stage, and what a
    stage has stored for itself is removed when its result is written."""
    at = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "corpus-pipeline")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        with scratch(spark):
            stage(spark, at, sf_dir).write.parquet(path)
        at = spark.read.parquet(path)
    return at
