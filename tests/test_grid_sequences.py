"""Grids, windows and sequences on hand-made frames."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flareframe.operators import grid as G
from flareframe.operators import sequences as Q
from flareframe.plans import flux_windows

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_resample_shows_gaps_and_skips_nan(spark):
    d = spark.createDataFrame([("a", at(0), 1.0), ("a", at(1), float("nan")), ("a", at(5), 3.0), ("a", at(35), 7.0)],
                              "s string, ts timestamp_ntz, v double")
    got = [(r["ts"], r["v"]) for r in G.resample_mean(d, ["s"], "ts", "v", "10 minutes").orderBy("ts").collect()]
    assert got == [(at(0), 2.0), (at(10), None), (at(20), None), (at(30), 7.0)]


@pytest.mark.parametrize("vals", [[None, 1, None, None, 4, None], [None, None], [5], [None, 2, None], [1, 2, 3]])
def test_fill_linear_equals_pandas(spark, vals):
    rows = [("k", i, None if v is None else float(v)) for i, v in enumerate(vals)]
    d = spark.createDataFrame(rows, "k string, pos long, v double")
    want = pd.Series([r[2] for r in rows], dtype=float).interpolate(limit_direction="both")
    for seg in (None, F.floor(F.col("pos") / 2)):
        got = [r["v"] for r in G.fill_linear(d, ["k"], "pos", "v", seg).orderBy("pos").collect()]
        assert got == [None if pd.isna(x) else pytest.approx(x) for x in want]


def test_day_windows_stay_in_their_day(spark):
    bg = spark.createDataFrame([("a", at(90), 1.0)], "satellite string, ts timestamp_ntz, background double")
    w = G.day_windows(bg, ["satellite"], "ts", "24 hours", "7 hours", "background").orderBy("start").collect()
    assert [r["start"] for r in w] == [at(90), at(90 + 420), at(90 + 840), at(90 + 1260)]
    with pytest.raises(ValueError):
        G.day_windows(bg, ["satellite"], "ts", "24 hours", "0 hours")


def test_skip_month_includes_its_last_day(spark):
    d = spark.createDataFrame([(dt.datetime(2024, 2, 29, 23, 59),), (dt.datetime(2024, 3, 1),)], "ts timestamp_ntz")
    assert [r["ts"].month for r in G.skip_ranges(d, "ts", ["2024-02:2024-02"]).collect()] == [3]


def test_flux_windows_rejects(spark):
    hours = [("g", at(60 * h), None if h in (3, 4, 5) else 2.0) for h in range(72)]
    flux = spark.createDataFrame(hours, "satellite string, ts timestamp_ntz, flux double")
    bg = spark.createDataFrame([("g", at(0), 1.0), ("g", at(1440), 0.0), ("g", at(2880), 4.0)],
                               "satellite string, ts timestamp_ntz, background double")
    ev = spark.createDataFrame([(at(2880 + 1440 + 5), 4, at(0), at(1), "M1")],
                               "t_occ timestamp_ntz, sev int, timestamp_start timestamp_ntz, timestamp_end timestamp_ntz, flare_type string")
    d = flux_windows.label_windows(flux, bg, ev, every="1 hour", min_coverage=0.875)
    r = {x["start"].day: x for x in d.collect()}
    assert [r[i]["reason"] for i in (1, 2, 3)] == ["ok", "background", "ok"]       # coverage 21/24 is exactly the limit
    assert r[1]["xrs_flux_ratio"] == [2.0] * 24 and r[3]["xrs_flux_ratio"] == [0.5] * 24
    assert r[3]["label"] == "M" and r[1]["label"] == "NONE"
    strict = flux_windows.label_windows(flux, bg, ev, every="1 hour", min_coverage=0.9)
    assert {x["start"].day: x["reason"] for x in strict.collect()}[1] == "coverage"
    assert flux_windows.flatten_windows(d.where("reason = 'ok'"), 24).count() == 2
    assert flux_windows.flatten_windows(d.where("reason = 'ok'"), 23).count() == 0


def images(spark, times, label="C"):
    return spark.createDataFrame([(1, at(m), label if i % 2 else "NONE", f"f{i}") for i, m in enumerate(times)],
                                 "ar long, ts timestamp_ntz, label string, file string")


def test_islands_and_duplicate_times(spark):
    d = images(spark, [0, 12, 24, 24, 36, 60, 72])
    got = [(r["island"], r["pos"]) for r in Q.islands(d, ["ar"], "ts", "12 minutes", ["file"], block=2).orderBy("ts", "file").collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]


@pytest.mark.parametrize("n,stride,count", [(4, 1, 2), (5, 1, 1), (6, 1, 0), (2, 7, 1), (2, None, 2)])
def test_fixed_series_lengths(spark, n, stride, count):
    d = images(spark, [0, 12, 24, 36, 48])
    out = Q.fixed_series(d, ["ar"], "ts", ["file"], n, 1, stride, "12 minutes", "label").collect()
    assert len(out) == count and all(len(r["file"]) == n for r in out)


def test_clips_need_exact_gaps(spark):
    d = images(spark, [0, 12, 24, 36, 50, 62, 74])
    c = Q.clips(d, ["ar"], "ts", "file", "label", 2, "24 minutes", "12 minutes", block=3).orderBy("t_start").collect()
    assert [r["filepaths"] for r in c] == [["f0", "f2"], ["f1", "f3"], ["f4", "f6"]]
    assert [r["label"] for r in c] == ["NONE", "C", "NONE"]


def test_labels_past_the_end_are_none(spark):
    d = images(spark, [0, 12, 24])
    got = [r["labels"] for r in Q.labels_at_steps(d, ["ar"], "ts", "label", [1, 5]).orderBy("ts").collect()]
    assert got == [["C", "NONE"], ["NONE", "NONE"], ["NONE", "NONE"]]


def test_unsorted_is_an_error(spark):
    d = images(spark, [0, 12, 12]).withColumn("i", F.substring("file", 2, 9).cast("long"))
    with pytest.raises(ValueError, match="strictly increasing"):
        Q.require_sorted(d, ["ar"], "ts", "i")


def test_clip_integrity_tolerance(spark):
    names = [["x_20240101_000000.png", "x_20240101_001201.png", "x_20240101_002403.png"], ["x_20240101_000000.png"]]
    d = spark.createDataFrame([(n,) for n in names], "filepaths array<string>")
    got = [(r["ok"], r["bad_positions"]) for r in Q.clip_integrity(d, "filepaths", "12 minutes").collect()]
    assert got == [(False, [1]), (True, [])]
