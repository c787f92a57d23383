"""Reading datasets, tables and reports into DataFrames."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flareframe.functions.arrays import nan_to_null
from flareframe.functions.labels import regression_label
from flareframe.functions.names import file_key_time, file_stem

IMAGE_EXTENSIONS = (".fits", ".png", ".jpg", ".jpeg")      # fixed values
CURVE_SCHEMA = ("threshold double, precision double, recall double, f1 double, tss double, "
                "hss double, mcc double, apss double")


def read_datalist(spark: SparkSession, path: str, key: str = "data",
                  schema: str | T.StructType | None = None) -> DataFrame:
    """Rows of JSON envelopes {"data": [...]}, one envelope per file.

    Give ``schema`` (of the rows) to skip the inference pass.  An envelope is
    one JSON document and cannot be split, so a file is one task: land large
    sets once as Parquet with ``write_dataset``.
    """
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        row = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        reader = reader.schema(T.StructType([T.StructField(key, T.ArrayType(row))]))
    df = reader.json(path)
    field = next((f for f in df.schema.fields if f.name == key), None)
    if field is None or not isinstance(field.dataType, T.ArrayType) \
            or not isinstance(field.dataType.elementType, T.StructType):
        raise ValueError(f"{path}: no array of records under {key!r}")
    return df.select(F.inline(F.col(key)))


def read_any(spark: SparkSession, source: str | Sequence[str], **options) -> DataFrame:
    """Dataset from a path by its extension: .json envelope, .csv series, an image; or
    from a list of images (one item)."""
    if not source:
        raise ValueError("empty source")
    if not isinstance(source, str):
        return read_images(spark, source)
    ext = os.path.splitext(source.rstrip("/"))[1].lower()
    if ext == ".json":
        return read_datalist(spark, source, **options)
    if ext == ".csv":
        return read_csv(spark, source, **options)
    if ext in IMAGE_EXTENSIONS:
        return read_images(spark, [source])
    raise ValueError(f"unsupported extension {ext!r}")


def read_images(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One item of the given image files, in their order; named after the first."""
    bad = [p for p in paths if os.path.splitext(p)[1].lower() not in IMAGE_EXTENSIONS]
    if bad or not paths:
        raise ValueError(f"not images: {bad}")
    files = F.array(*[F.lit(p) for p in paths])
    return spark.range(1).select(files.alias("filepaths"), file_stem(F.lit(paths[0])).alias("sname"))


def list_images(spark: SparkSession, path: str, pattern: str = "*", key: Column | None = None
                ) -> DataFrame:
    """Image files below ``path``, without their content; with ``key`` (of the column
    ``path``) one item per key with its sorted files -- a clip's worth per key."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", pattern).load(path).select("path"))
    if key is None:
        return df.select(F.array("path").alias("filepaths"), file_stem(F.col("path")).alias("sname"))
    return df.groupBy(key.alias("sname")).agg(F.sort_array(F.collect_list("path")).alias("filepaths"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(ImgName, Label) rows; '#' starts a comment; labels stay text; the last line of a
    name wins."""
    df = (spark.read.schema("ImgName string, Label string").option("comment", "#")
          .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path))
    line = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                    F.monotonically_increasing_id())
    df = df.select("ImgName", "Label", line.alias("__at")).where(F.col("ImgName").isNotNull())
    # a null label of the last line must win too, so it travels in a struct
    return df.groupBy("ImgName").agg(F.max_by(F.struct("Label"), "__at").alias("r")) \
        .select("ImgName", "r.Label")


def by_layout(spark: SparkSession, paths: str | Sequence[str], fmt: str, pattern: str = "*", **options) -> list[DataFrame]:
    """The files below ``paths`` as one DataFrame per layout: files with the same columns in the same order and types.

    The header or footer of every file is read once, sixteen files at a time; names and types are all that reaches
    the driver.  Each layout is then read with its own columns, so a name means the same in all files of a DataFrame.
    Files without columns (empty ones) are in none.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern) \
        .load(paths if isinstance(paths, str) else list(paths)).where("length > 0").select("path").distinct()
    files = sorted(re.sub(r"([\[\]{}*?\\])", r"\\\1", r.path) for r in found.toLocalIterator())

    def columns(path: str) -> T.StructType:
        return spark.read.format(fmt).options(**options).load(path).schema
    layouts: dict[str, tuple[T.StructType, list[str]]] = {}
    with ThreadPoolExecutor(16) as pool:
        for path, schema in zip(files, pool.map(columns, files)):
            if schema.fields:
                layouts.setdefault(schema.json(), (schema, []))[1].append(path)
    return [spark.read.format(fmt).options(**options).schema(schema).load(group) for schema, group in layouts.values()]


def union_layouts(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_events(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Normalised events of CSV files with a header; each file may have its columns in its own order, case and alias.

    Files that are empty, or hold nothing but a header, give no events.
    """
    from flareframe.operators.events import normalise_events
    parts = by_layout(spark, paths, "csv", header=True, inferSchema=False)
    return union_layouts([normalise_events(p) for p in parts or [spark.createDataFrame([], "timestamp string, class string")]])


def read_keys(spark: SparkSession, path: str, name: str = "ar") -> DataFrame:
    """One key per line, '#' lines and blanks skipped."""
    v = F.trim(F.col("value"))
    return spark.read.text(path).select(v.alias(name)) \
        .where((F.col(name) != "") & ~F.col(name).startswith("#"))


def read_feature_rows(spark: SparkSession, path: str, n_features: int = 29) -> DataFrame:
    """Headerless rows whose last fields are features, class, size label and file name.

    Extra leading fields are ignored.  Rows that are too short or whose features
    do not parse come back with ``error`` set instead of failing the read.
    """
    width = n_features + 3
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    df = spark.read.text(path).select(parts.alias("p")).where(F.get("p", F.lit(0)) != "")
    a = F.slice("p", F.lit(-width), F.lit(width))
    long_enough = F.size("p") >= width
    df = df.select(F.when(long_enough, a).alias("a"), "p")
    feats = F.transform(F.slice("a", 1, n_features), lambda x: x.try_cast("double"))
    df = df.select(feats.alias("features"), F.get("a", F.lit(n_features)).try_cast("int").alias("class_label"),
                   F.when(F.col("a").isNotNull(), regression_label(F.get("a", F.lit(n_features + 1))))
                   .alias("reg_label"), F.get("a", F.lit(n_features + 2)).alias("fname"))
    error = (F.when(F.col("fname").isNull(), "short row")
             .when(F.exists("features", lambda x: x.isNull()), "feature"))
    k = file_key_time(F.col("fname"))
    return df.select(k["ar"].alias("ar"), k["ts"].alias("ts"), "features", "class_label",
                     "reg_label", "fname", error.alias("error"))


def resolve_column(df: DataFrame, candidates: Sequence[str], pattern: str | None = None) -> str:
    """First candidate present (exact, then any case), else the first column matching
    ``pattern``."""
    for c in candidates:
        if c in df.columns:
            return c
    lower = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    if pattern:
        for c in df.columns:
            if re.search(pattern, c, re.IGNORECASE):
                return c
    raise KeyError(f"none of {list(candidates)} in {df.columns}")


def read_series(spark: SparkSession, path: str, time_names: Sequence[str], value_names: Sequence[str],
                value_pattern: str | None = None, name: str = "flux", fmt: str = "parquet",
                satellite: str | None = None, pattern: str = "*") -> DataFrame:
    """(satellite, ts, value) of all files below ``path``; NaN becomes null.

    The time and value columns are looked up in each file by itself, so files may name, order and type their columns
    differently; a file that has none of the names fails the read with its columns named.
    """
    def one(df: DataFrame) -> DataFrame:
        t, v = resolve_column(df, time_names), resolve_column(df, value_names, value_pattern)
        sat = F.lit(satellite) if satellite else (
            F.col("satellite").cast("string") if "satellite" in df.columns else F.lit(None).cast("string"))
        return df.select(sat.alias("satellite"), F.col(f"`{t}`").cast("timestamp_ntz").alias("ts"),
                         nan_to_null(F.col(f"`{v}`").cast("double")).alias(name))
    options = {"header": True} if fmt == "csv" else {}
    parts = by_layout(spark, path, fmt, pattern, **options)
    if not parts:
        return spark.createDataFrame([], f"satellite string, ts timestamp_ntz, {name} double")
    return union_layouts([one(p) for p in parts])


def read_curves(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Threshold curves; the file is the run."""
    df = spark.read.schema(CURVE_SCHEMA).option("header", True) \
        .option("recursiveFileLookup", "true").csv(paths if isinstance(paths, str) else list(paths))
    return df.select(F.col("_metadata.file_path").alias("run"), "*")


def read_dataset(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Parquet rows written by ``write_dataset`` or ``write_windows``.

    One folder per value means no file at all where no row was written, so the schema cannot come from the files.
    """
    return spark.read.schema(schema).parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Fitted scaler statistics written by ``write_stats``."""
    return spark.read.parquet(path)


# Layout of split-summary reports.
_TABLE = r"^\[(train|cv|test)\]\s+(Per-label|Collapsed) composition"
_BREAKDOWN = r"^(?i)Label breakdown per NEW split:"
_SPLIT = r"^(?i)\s*\[(train|cv|test)\]\s+total\s*=\s*(\d+)"
_ITEM = r"^\s*-\s*(.+?)\s*:\s*(\d+)\s*\(([0-9.]+)%\)"


def read_split_summaries(spark: SparkSession, top: str, pattern: str = "*.txt") -> DataFrame:
    """Composition rows (run, category, split, label, n, frac) of every report below ``top``.

    A report is a small text file, read whole; section headings carry forward
    over its lines.  Without any table the label breakdown is used instead.
    """
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", pattern).text(top)
    lines = text.select(F.col("_metadata.file_path").alias("run"),
                        F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    x = F.col("line")
    w = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def has(p: str) -> Column:
        return F.regexp_like(x, F.lit(p))

    table = "(?i)" + _TABLE
    head = (F.when(has(table), F.struct(
        F.when(F.lower(F.regexp_extract(x, table, 2)) == "collapsed", "collapsed")
        .otherwise("per_label").alias("category"), F.lower(F.regexp_extract(x, table, 1)).alias("split")))
        .when(has(_BREAKDOWN), F.struct(F.lit("breakdown").alias("category"), F.lit("").alias("split")))
        .when(has(_SPLIT), F.struct(F.lit("breakdown").alias("category"),
                                    F.lower(F.regexp_extract(x, _SPLIT, 1)).alias("split")))
        .when(F.trim(x) == "", F.struct(F.lit("none").alias("category"), F.lit("").alias("split"))))
    d = lines.withColumn("h", F.last(head, ignorenulls=True).over(w))
    in_table = F.col("h.category").isin("per_label", "collapsed")
    cells = F.split(x, r"\|")                              # label | before | after | change
    after = F.split(F.trim(F.get(cells, F.lit(2))), r"\s+")
    n, share = F.get(after, F.lit(0)).try_cast("long"), F.rtrim(F.get(after, F.lit(1)), F.lit("%")).try_cast("double")
    row = (F.when(in_table & (F.size(cells) == 4) & n.isNotNull() & share.isNotNull(), F.struct(
        F.trim(F.get(cells, F.lit(0))).alias("label"), n.alias("n"), (share / 100).alias("frac")))
        .when((F.col("h.category") == "breakdown") & (F.col("h.split") != "") & has(_ITEM), F.struct(
            F.regexp_extract(x, _ITEM, 1).alias("label"), F.regexp_extract(x, _ITEM, 2).cast("long").alias("n"),
            (F.regexp_extract(x, _ITEM, 3).cast("double") / 100).alias("frac"))))
    d = d.withColumn("r", row).where(F.col("r").isNotNull())
    tables = F.max(F.col("h.category").isin("per_label", "collapsed")).over(Window.partitionBy("run"))
    d = d.withColumn("__tables", tables)
    d = d.where(~F.col("__tables") | (F.col("h.category") != "breakdown"))
    cat = F.when(F.col("h.category") == "breakdown", "per_label").otherwise(F.col("h.category"))
    return d.select("run", cat.alias("category"), F.col("h.split").alias("split"), "r.label", "r.n", "r.frac")
