"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "flareframe", master: str | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    """A UTC session with adaptive execution and skew-join handling on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the
    submit-time settings win, and AQE coalesces small shuffle partitions.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.ui.enabled", "false"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return prepare(b.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the one runtime setting results depend on: all times are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and read it from there.

    For small derived tables (counts per group, fitted statistics) that a plan
    uses several times.  Written files cut the lineage and survive lost executors.
    """
    path = folder(df.sparkSession, "step")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; :func:`scratch` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove on leaving all tables that steps inside have stored.

    Results that read them have to be written before: a DataFrame made inside is no longer good outside.
    """
    mark = len(_made)
    try:
        yield
    finally:
        while len(_made) > mark:
            remove(spark, _made.pop())


@contextmanager
def noted(into: list[str]) -> Iterator[None]:
    """Add to ``into`` the folders of all tables that steps inside have stored."""
    mark = len(_made)
    try:
        yield
    finally:
        into.extend(_made[mark:])


_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Without that setting a temporary folder serves local mode only, where all tasks share the disk, and
    is removed when the process ends; on a cluster the setting is required.
    """
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None) \
        or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="flareframe-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return _local
