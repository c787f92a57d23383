"""Readers over files that do not agree on their columns."""

import datetime as dt

import pytest
from flareframe.sources import readers as R


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_events_of_files_with_other_columns(spark, tmp_path):
    d = tmp_path / "events"
    write(d / "a.csv", "start_time,timestamp_end,class\n2024-01-01 00:00:00,2024-01-01 01:00:00,C1.0\n")
    write(d / "b.csv", "CLASS,Timestamp_End,START_TIME\nM2.0,2024-01-02 01:00:00,2024-01-02 00:00:00\n")
    write(d / "deep" / "c [1].csv", "timestamp,flare_type,note\n2024-01-03 00:00:00,\"X1.0\",\"a, b\"\n")
    write(d / "header.csv", "start_time,class\n")
    write(d / "empty.csv", "")
    got = sorted((r["class"], r.t_occ, r.timestamp_end) for r in R.read_events(spark, str(d)).collect())
    day = [dt.datetime(2024, 1, i) for i in (1, 2, 3)]
    hour = dt.timedelta(hours=1)
    assert got == [("C", day[0], day[0] + hour), ("M", day[1], day[1] + hour), ("X", day[2], None)]
    two = R.read_events(spark, [str(d / "a.csv"), str(d / "b.csv")])
    assert two.count() == 2
    write(tmp_path / "none" / "x.csv", "")
    assert R.read_events(spark, str(tmp_path / "none")).count() == 0


def test_series_of_files_with_other_columns(spark, tmp_path):
    path = str(tmp_path / "flux")
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(t, 1.0)], "time timestamp_ntz, flux double").coalesce(1).write.parquet(f"{path}/a")
    spark.createDataFrame([(2.5, t, 9.0)], "xrsb_flux float, time_tag timestamp, flux double").coalesce(1).write.parquet(f"{path}/b")
    spark.createDataFrame([("s", "nan", t)], "satellite string, XRSB_obs string, Time_Tag timestamp_ntz").coalesce(1).write.parquet(f"{path}/c")
    got = R.read_series(spark, path, ["time", "time_tag"], ["xrsb_flux", "flux"], "xrsb").collect()
    assert sorted((str(r.satellite), r.ts, str(r.flux)) for r in got) == [("None", t, "1.0"), ("None", t, "2.5"), ("s", t, "None")]
    spark.createDataFrame([(1, 2)], "p int, q int").coalesce(1).write.parquet(f"{path}/d")
    with pytest.raises(KeyError, match="p.*q"):
        R.read_series(spark, path, ["time", "time_tag"], ["xrsb_flux", "flux"], "xrsb")


def test_layouts(spark, tmp_path):
    """A layout is names, order and types; files of one layout are read together."""
    for i in range(5):
        write(tmp_path / f"{i}.csv", "a,b\n1,2\n" if i % 2 else "b,a\n1,2\n")
    parts = R.by_layout(spark, str(tmp_path), "csv", header=True)
    assert sorted((p.columns, p.count()) for p in parts) == [(["a", "b"], 2), (["b", "a"], 3)]
    assert len(R.by_layout(spark, str(tmp_path), "csv", "[13].csv", header=True)) == 1


def test_windows_that_are_all_rejected_read_back_empty(spark, tmp_path):
    """No window passes, so no folder of a satellite is written."""
    from flareframe.queries import all_queries
    rows = [(i, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "error", 400.0, None) for i in range(72)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string") \
        .write.parquet(str(tmp_path / "events.parquet"))
    got = all_queries()["s15_write_windows"](spark, str(tmp_path))
    assert got.columns == ["satellite", "date_start", "label", "chk"] and got.collect() == []
