"""A user model is set up once per task; stored steps are removed."""

import os
import uuid

from flareframe import session
from flareframe.operators.predictions import score_with
from pyspark.sql import functions as F


def model():
    """Functions that workers get by value."""
    def load():
        return uuid.uuid4().hex

    def tag(pdf, loaded):
        from pyspark import TaskContext
        return pdf.assign(model=loaded, task=TaskContext.get().taskAttemptId(), batch=uuid.uuid4().hex)
    return load, tag


def test_setup_runs_once_a_task(spark):
    load, tag = model()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(1000).repartition(4)
        out = score_with(df, tag, "id long, model string, task long, batch string", setup=load)
        got = out.groupBy("task").agg(F.countDistinct("model").alias("m"), F.countDistinct("batch").alias("b"), F.first("model").alias("x")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 4 == len({r.x for r in got})
    assert all(r.m == 1 and r.b >= 4 for r in got)


def test_no_setup_without_rows(spark):
    def fail():
        raise RuntimeError("not wanted")
    assert score_with(spark.range(0), model()[1], "id long, model string, task long, batch string", setup=fail).count() == 0


def test_scratch_removes_stored_steps(spark, tmp_path):
    outer = session.materialise(spark.range(3))
    with session.scratch(spark):
        df = session.materialise(spark.range(5))
        path = df.inputFiles()[0].removeprefix("file:").removeprefix("//")
        df.write.parquet(str(tmp_path / "kept"))
        assert os.path.exists(path)
    assert not os.path.exists(path)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 5 and outer.count() == 3
