"""Writing datasets, windows, predictions and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flareframe.functions.names import base_name, base_names
from flareframe.operators import reports as R


def write_dataset(df: DataFrame, path: str, by: Sequence[str] | None = None,
                  fmt: str = "parquet") -> None:
    """Rows as Parquet or JSON Lines, optionally one folder per value of ``by``."""
    w = df.write.mode("overwrite").format(fmt)
    (w.partitionBy(*by) if by else w).save(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def write_curves(curves: DataFrame, path: str, run: str | None = None) -> None:
    """Threshold curves as CSV, one folder per run."""
    cols = ["threshold", "precision", "recall", "f1", "tss", "hss", "mcc", "apss"]
    d = curves.select(*([run] if run else []), *cols)
    w = (d.repartition(run) if run else d.coalesce(1)).sortWithinPartitions("threshold").write
    w = w.mode("overwrite").option("header", True)
    (w.partitionBy(run) if run else w).csv(path)        # 1001 rows per run at most


def write_windows(windows: DataFrame, path: str) -> None:
    """Windows with their arrays, one folder per satellite."""
    write_dataset(windows, path, ["satellite"])


def write_flat_windows(flat: DataFrame, path: str) -> None:
    """Wide window rows (see ``flatten_windows``) as CSV with 10 significant digits."""
    num = [c for c, t in flat.dtypes if t in ("float", "double")]
    text = {c: F.regexp_replace(F.format_string("%.10g", F.col(c).cast("double")), r"(\.\d*?)0+$|(\.)0+$", "$1")
            for c in num}
    write_csv(flat.withColumns({c: F.regexp_replace(t, r"\.$", "") for c, t in text.items()}), path)


def write_stats(stats: DataFrame, path: str) -> None:
    """Fitted statistics, kept to be applied to later data."""
    stats.coalesce(1).write.mode("overwrite").parquet(path)     # one row per feature


def prediction_rows(df: DataFrame, base_names_only: bool = False) -> DataFrame:
    """Prediction records, with directories cut off the file paths if asked."""
    if not base_names_only:
        return df
    if "filepaths" in df.columns:
        df = df.withColumn("filepaths", base_names(F.col("filepaths")))
    return df.withColumn("filepath", base_name(F.col("filepath"))) if "filepath" in df.columns else df


def write_predictions(df: DataFrame, path: str, base_names_only: bool = False) -> None:
    write_dataset(prediction_rows(df, base_names_only), path, fmt="json")


def write_augmented(df: DataFrame, path: str, error: str = "xrs_error") -> None:
    """Augmented rows and, next to them, the count of every outcome."""
    write_dataset(df, f"{path}/rows")
    reason = df.withColumn("reason", F.coalesce(F.col(error), F.lit("ok")))
    write_dataset(R.reason_counts(reason), f"{path}/stats")


def write_distribution(df: DataFrame, path: str, label: str = "label", group: str = "ar") -> None:
    """Class counts and rows per group of every split, as CSV."""
    write_csv(R.class_counts(df, label, ["split"]), f"{path}/class_counts")
    write_csv(R.class_counts(df, group, ["split"]), f"{path}/group_counts")


def write_label_csv(df: DataFrame, path: str, group: str, ts: str, name: str, label: str) -> None:
    """(name, label) rows in (entity, time) order with the labels as they came."""
    write_csv(df.orderBy(group, ts, name).select(F.col(name).alias("ImgName"), F.col(label).alias("Label")), path)


def write_spot_check(df: DataFrame, path: str, frames: str, cols: Sequence[str]) -> None:
    write_csv(R.spot_check(df, frames, cols), path)


def summary_lines(comp: DataFrame, collapsed: bool = False) -> DataFrame:
    """Text lines (split, line_no, line) of a composition comparison: one table per split."""
    title = "Collapsed composition (NONE vs M+ vs OTHER)" if collapsed else \
        "Per-label composition (original vs new)"
    def cell(n: str, frac: str, sign: str = "") -> Column:
        return F.format_string(f"%{sign}d %{sign}.2f%%", n, F.col(frac) * 100)
    row = F.concat_ws(" | ", "label", cell("orig_n", "orig_frac"), cell("new_n", "new_frac"), cell("d_n", "d_frac", "+"))
    rows = comp.select("split", F.struct(F.lit(2).alias("k"), (-F.col("orig_n")).alias("n"),
                                         F.col("label")).alias("o"), row.alias("line"))
    heads = comp.select("split").distinct().select("split", F.explode(F.array(*[
        F.struct(F.lit(i).alias("k"), s.alias("line")) for i, s in enumerate((
            F.concat(F.lit("["), F.col("split"), F.lit(f"] {title}:")),
            F.lit("label | before | after | change")))]))
        .alias("h")).select("split", F.struct(F.col("h.k").alias("k"), F.lit(0).cast("long").alias("n"),
                                              F.lit("").alias("label")).alias("o"), "h.line")
    return heads.unionByName(rows)


def write_split_report(path: str, comp: DataFrame, collapsed: DataFrame, movement: DataFrame,
                       exclusivity: DataFrame, sizes: DataFrame) -> None:
    """Report tables of a split (composition, movement, exclusivity, sizes) and a text
    summary of the composition."""
    for name, t in (("composition", comp), ("collapsed", collapsed), ("movement", movement),
                    ("exclusivity", exclusivity), ("sizes", sizes)):
        write_dataset(t, f"{path}/{name}")
    lines = summary_lines(comp).withColumn("b", F.lit(0)).unionByName(
        summary_lines(collapsed, True).withColumn("b", F.lit(1)))
    # a few dozen lines: one file
    lines.coalesce(1).sortWithinPartitions("b", "split", "o").select("line") \
        .write.mode("overwrite").text(f"{path}/summary")
