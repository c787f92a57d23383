"""Labels of streamed windows against the batch operator."""

import datetime as dt
import random

from flareframe.operators.events import label_ahead
from flareframe.streaming.labels import label_ahead_stream, latest_labels, run_labels

T0 = dt.datetime(2024, 3, 1)
WINDOWS, EVENTS = "wid long, ar long, end timestamp_ntz", "ar long, t_occ timestamp_ntz, sev int, class string"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    rng = random.Random(6)
    windows = [(i, i % 3, at(i * 0.5)) for i in range(96)]
    events = [(rng.randint(0, 2), at(round(rng.uniform(0, 60), 3)), rng.randint(1, 5), "") for _ in range(60)]
    events += [(0, at(10 + 1), 5, ""), (1, at(10.5 + 1 + 6), 5, "")]          # on the open and on the closed bound
    far = 400
    folder, win, evs = (str(tmp_path / x) for x in ("out", "win", "evs"))
    for part in range(4):                                     # rising days, the streams restarted for each
        lo, hi = part * 15, part * 15 + 15
        w = [x for x in windows if at(lo) <= x[2] < at(hi)] + ([(1000, 0, at(far))] if part == 3 else [])
        e = [x for x in events if at(lo) <= x[1] < at(hi)] + ([(0, at(far), 1, "")] if part == 3 else [])
        spark.createDataFrame(w, WINDOWS).coalesce(1).write.mode("append").parquet(win)
        spark.createDataFrame(e, EVENTS).coalesce(1).write.mode("append").parquet(evs)
        streams = [spark.readStream.schema(s).parquet(p) for s, p in ((WINDOWS, win), (EVENTS, evs))]
        run_labels(label_ahead_stream(*streams, ["ar"], "wid", "end", "6 hours", "1 hour", late="16 hours"), folder)
        if part == 1:                                         # nothing is told of windows whose horizon is open
            known = {r.id for r in spark.read.parquet(f"{folder}/labels").where("sev IS NULL").collect()}
            assert all(at(i * 0.5 + 7) <= at(30 - 16) for i in known)
    # an event far behind its stream's watermark is dropped
    spark.createDataFrame([(0, at(1.5), 5, "")], EVENTS).coalesce(1).write.mode("append").parquet(evs)
    streams = [spark.readStream.schema(s).parquet(p) for s, p in ((WINDOWS, win), (EVENTS, evs))]
    run_labels(label_ahead_stream(*streams, ["ar"], "wid", "end", "6 hours", "1 hour", late="16 hours"), folder)
    got = {r.id: r.flare_class for r in latest_labels(spark, folder).collect()}
    want = label_ahead(spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(events, EVENTS), ["ar"], "end", "6 hours", "1 hour")
    assert {i: c for i, c in got.items() if i < 1000} == {r.wid: r.flare_class for r in want.collect()}
    assert len(set(got.values())) > 3


def test_dense_events_give_a_window_few_rows(spark, tmp_path):
    """Windows and events at the same minutes of a day: rows a window do not grow with the events in its range."""
    win, evs, folder = (str(tmp_path / x) for x in ("win", "evs", "out"))
    windows = [(i, 0, at(i / 4)) for i in range(96)] + [(1000, 0, at(400))]
    events = [(0, at(i / 60), 1 + (i % 7 == 0) + 3 * (i % 977 == 0), "") for i in range(24 * 60)] + [(0, at(400), 1, "")]
    spark.createDataFrame(windows, WINDOWS).coalesce(1).write.parquet(win)
    spark.createDataFrame(events, EVENTS).coalesce(1).write.parquet(evs)
    streams = [spark.readStream.schema(s).parquet(p) for s, p in ((WINDOWS, win), (EVENTS, evs))]
    run_labels(label_ahead_stream(*streams, ["ar"], "wid", "end", "6 hours", "1 hour"), folder)
    rows = spark.read.parquet(f"{folder}/labels").groupBy("id").count().collect()
    assert max(r["count"] for r in rows) <= 2 * 4                              # two bins, four classes
    got = {r.id: r.flare_class for r in latest_labels(spark, folder).collect() if r.id < 1000}
    want = label_ahead(spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(events, EVENTS), ["ar"], "end", "6 hours", "1 hour")
    assert got == {r.wid: r.flare_class for r in want.collect() if r.wid < 1000} and len(set(got.values())) > 2
