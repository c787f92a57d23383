"""Event labelling and history against brute force, bounds included."""

import datetime as dt
import random

import pytest

from flareframe.functions.labels import SEVERITY
from flareframe.operators import events as E

T0 = dt.datetime(2024, 1, 1)
NAMES = {v: k for k, v in SEVERITY.items()}


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    evs = [(rnd.choice([1, 1, 1, 2]), rnd.randrange(0, 4000, 10), rnd.choice("ABCMX"), rnd.choice([0, 7, 30, 600]))
           for _ in range(200)]
    wins = [(k, s) for k in (1, 2, 3) for s in range(0, 4000, 50)]
    e = spark.createDataFrame([(k, at(t), SEVERITY[c], at(t), at(t + n), f" {c.lower()}2.5") for k, t, c, n in evs],
                              "k long, t_occ timestamp_ntz, sev int, timestamp_start timestamp_ntz, "
                              "timestamp_end timestamp_ntz, flare_type string")
    w = spark.createDataFrame([(k, at(s), at(s + 60)) for k, s in wins], "k long, start timestamp_ntz, end timestamp_ntz")
    return evs, wins, e, w


def test_label_ahead_open_left_closed_right(data):
    evs, wins, e, w = data
    got = {(r["k"], r["end"]): r["flare_class"] for r in E.label_ahead(w, e, ["k"], "end", "100 minutes", "30 minutes").collect()}
    for k, s in wins:
        lo = s + 90
        sev = max([SEVERITY[c] for q, t, c, _ in evs if q == k and lo < t <= lo + 100], default=0)
        assert got[k, at(s + 60)] == NAMES[sev]
    assert len(got) == len(wins)


def test_events_within_closed(data):
    evs, wins, e, w = data
    got = {(r["k"], r["start"]): r["s"] for r in E.events_within(w, e, ["k"], "start", "end", "s").collect()}
    for k, s in wins:
        assert got[k, at(s)] == max([SEVERITY[c] for q, t, c, _ in evs if q == k and s <= t <= s + 60], default=0)


def test_label_without_key_and_without_events(spark, data):
    evs, wins, e, w = data
    none = E.label_ahead(w, e.where("false"), [], "end", "1 hour")
    assert {r[0] for r in none.select("flare_class").distinct().collect()} == {"NONE"}
    got = E.label_ahead(w.select("start", "end").distinct(), e, [], "end", "1 hour").collect()
    for r in got:
        sev = max([SEVERITY[c] for _, t, c, _ in evs if r["end"] < at(t) <= r["end"] + dt.timedelta(hours=1)], default=0)
        assert r["flare_class"] == NAMES[sev]


@pytest.mark.parametrize("encoding,skip", [("binary", False), ("ordinal", False), ("ordinal", True), ("binary", True)])
def test_history(data, encoding, skip):
    evs, wins, e, w = data
    g = w.selectExpr("k", "start AS ts")
    codes = {"C": 1, "M": 2, "X": 3} if skip else {"A": 1, "B": 2, "C": 3, "M": 4, "X": 5}
    got = {(r["k"], r["ts"]): r["hist"] for r in E.history_channel(g, e, ["k"], "ts", encoding, skip).collect()}
    for k, s in wins:
        on = [codes[c] if encoding == "ordinal" else 1 for q, t, c, n in evs if q == k and c in codes and t <= s <= t + n]
        assert got[k, at(s)] == max(on, default=0)


def test_history_ignores_open_ended_events(spark):
    e = spark.createDataFrame([(at(0), None, "X1"), (None, at(9), "X1")],
                              "timestamp_start timestamp_ntz, timestamp_end timestamp_ntz, flare_type string")
    g = spark.createDataFrame([(at(1),)], "ts timestamp_ntz")
    assert E.history_channel(g, e, [], "ts").first()["hist"] == 0


def test_normalise_events(spark):
    raw = spark.createDataFrame([("2024-01-01 00:05:00", "2024-01-01 00:00:00", "m1.0"), (None, "2024-01-01 01:00:00", " X9"),
                                 ("bad", None, "C1"), ("2024-01-02", None, "Z1"), ("2024-01-03", None, None)],
                                "TIMESTAMP string, Start_Time string, Flare_Type string")
    rows = sorted((r["class"], r["t_occ"]) for r in E.normalise_events(raw).collect())
    assert rows == [("M", at(5)), ("X", at(60))]


def test_stream_drops_late_rows_and_frees_state(spark, tmp_path):
    from flareframe.streaming.resample import latest_bins, resample_stream, run_bins
    files = [[("a", "2024-01-01 01:10:00", 1.0), ("a", "2024-01-01 01:20:00", 3.0)],
             [("a", "2024-01-01 09:30:00", 5.0)],
             [("a", "2024-01-01 01:30:00", 99.0), ("a", "2024-01-01 09:40:00", 7.0)]]
    schema = "k string, ts timestamp_ntz, v double"
    for i, rows in enumerate(files):
        d = spark.createDataFrame(rows, "k string, ts string, v double").selectExpr("k", "to_timestamp_ntz(ts) AS ts", "v")
        d.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        live = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        run_bins(resample_stream(live, ["k"], "ts", "v", "1 hour", "1 hour"), str(tmp_path / "out"))
    got = {str(r.ts)[11:13]: r.v for r in latest_bins(spark, str(tmp_path / "out"), ["k", "ts"]).collect()}
    assert got == {"01": 2.0, "09": 6.0}


def test_windows_with_a_null_bound_stay(spark):
    w = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", None)], "k string, e string") \
        .selectExpr("k", "to_timestamp_ntz(e) AS e", "to_timestamp_ntz('2024-01-01 00:00:00') AS s")
    ev = spark.createDataFrame([("a", "2024-01-01 03:00:00", 5)], "k string, t string, sev int") \
        .selectExpr("k", "to_timestamp_ntz(t) AS t_occ", "sev")
    assert sorted(r.flare_class for r in E.label_ahead(w, ev, ["k"], "e", "6 hours").collect()) == ["NONE", "X"]
    assert E.events_within(w, ev, ["k"], "s", "e").count() == 2
