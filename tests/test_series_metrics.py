"""Edge cases of series transforms, decoding, metrics and readers."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from flareframe.functions import arrays as A
from flareframe.functions import decode as D
from flareframe.operators import curves as C
from flareframe.operators import expected as X
from flareframe.operators import metrics as M
from flareframe.operators import multilabel as L
from flareframe.operators import reports as R
from flareframe.operators import series as S
from flareframe.operators import weights as W
from flareframe.sources import readers, writers

NAN, INF = float("nan"), float("inf")


def one(spark, a, fn):
    return spark.createDataFrame([(a,)], "a array<double>").select(fn(F.col("a")).alias("x")).first()["x"]


def test_constant_single_empty_series(spark):
    assert one(spark, [3.0, 3.0], A.minmax) == [0.5, 0.5]
    assert one(spark, [], A.minmax) == []
    assert one(spark, [7.0], A.log_stretch) == [0.0]
    assert one(spark, [0.0, NAN, INF], A.rescale) is None
    assert one(spark, [2.0, 2.0], lambda a: A.rescale(a, 1.0, 3.0)) == [1.0, 1.0]
    assert one(spark, [NAN, -INF, 1.0, None], A.zero_nonfinite) == [0.0, 0.0, 1.0, 0.0]


def test_percentile_and_asinh_equal_numpy(spark):
    rnd = random.Random(1)
    a = [rnd.uniform(-3, 9) for _ in range(37)]
    for q in (0, 0.5, 50, 99.5, 100):
        assert one(spark, a, lambda c: A.percentile(c, q)) == pytest.approx(np.percentile(a, q))
    x = np.array(a)
    s = ((x - x.min()) / (x.max() - x.min()) - 0.5) * 2
    lo, hi = np.percentile(s, 0.5), np.percentile(s, 99.5)
    y = np.clip(s, lo, hi) / max(abs(lo), abs(hi))
    want = (np.arcsinh(y / 0.5) / np.arcsinh(1 / 0.5) + 1) / 2
    assert one(spark, a, A.asinh_stretch) == pytest.approx(want.tolist(), abs=1e-6)


@pytest.mark.parametrize("vals", [[1.0], [1.0, 2.0], [5.0] * 9, [0.0] * 500 + [1e9] * 499, list(range(1001)), [1.0, NAN, 4.0]])
def test_exact_median(spark, vals):
    d = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(4)
    want = statistics.median([v for v in vals if not (isinstance(v, float) and math.isnan(v))])
    assert S.exact_median(d, [], "v").first()["median"] == want


def test_exact_median_when_the_sketch_misses(spark):
    """A coarse sketch must not change the answer."""
    rnd = random.Random(2)
    vals = [rnd.lognormvariate(0, 3) for _ in range(4001)]
    d = spark.createDataFrame([(i % 2, v) for i, v in enumerate(vals)], "k int, v double").repartition(8)
    got = {r["k"]: r["median"] for r in S.exact_median(d, ["k"], "v", accuracy=50, few_keys=True).collect()}
    assert got == {k: statistics.median(vals[k::2]) for k in (0, 1)}


def test_scalers_guard_zero_spread_and_missing_stats(spark):
    d = spark.createDataFrame([([4.0, 4.0], [1.0, 3.0])], "a array<double>, b array<double>")
    for kind, want in (("zscore", [0.0, 0.0]), ("robust", [0.0, 0.0]), ("minmax", [0.5, 0.5])):
        st = S.fit_scaler(d, ["a"], kind)
        r = S.apply_scaler(d, ["a", "b"], st, kind).first()
        assert r["a"] == want
        assert r["b"] == ([0.5, 0.5] if kind == "minmax" else [1.0, 3.0])


def test_tokens_drop_the_tail(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [1.0])], "id long, a array<double>")
    rows = S.patch_tokens(d, "id", ["a"], 2).orderBy("token").collect()
    assert [(r["sample_id"], r["values"]) for r in rows] == [(1, [1.0, 2.0]), (1, [3.0, 4.0])]


def test_decode_extremes(spark):
    assert one(spark, [1000.0, 1000.0], D.softmax) == [0.5, 0.5]
    assert one(spark, [2.0, 2.0, 1.0], D.argmax) == 0
    p = one(spark, [-5.0, 5.0, 0.0], D.ordinal_probs)
    assert sum(p) == pytest.approx(1) and min(p) > 0
    assert one(spark, [-800.0, 800.0], lambda a: F.transform(a, D.sigmoid)) == [0.0, 1.0]


def test_threshold_curves_equal_brute_force(spark):
    rnd = random.Random(5)
    p = [i * 0.001 for i in range(1001)] + [i / 1000 for i in range(1001)] + [rnd.random() for _ in range(300)] + [0.0, 1.0]
    rows = [(x, rnd.random() < x) for x in p] + [(None, True), (-0.5, False)]
    d = spark.createDataFrame([(x, int(y)) for x, y in rows], "p double, y int")
    got = {r["tick"]: r for r in C.tick_counts(d, "p", "y").collect()}
    for i, t in enumerate(np.linspace(0, 1, 1001)):
        assert got[i]["threshold"] == t
        assert got[i]["tp"] == sum(1 for x, y in rows if y and x is not None and x >= t)
        assert got[i]["fp"] == sum(1 for x, y in rows if not y and x is not None and x >= t)
        assert got[i]["tp"] + got[i]["fn"] == sum(y for _, y in rows)


def test_metrics_with_absent_classes(spark):
    d = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, yhat int")
    cm = M.confusion(d, "y", "yhat", 3)
    r = {x["cls"]: x for x in M.skill_scores(M.one_vs_rest(cm)).collect()}
    assert r[2]["ppv"] is None and r[2]["support"] == 0 and r[1]["tpr"] == 0
    f = M.weighted_f1(cm).first()
    assert f["f1_micro"] == pytest.approx(2 / 3) and f["precision"] == pytest.approx(4 / 9)
    assert M.multiclass_mcc(cm).first()["mcc"] == 0.0


def test_perfect_and_single_class(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 1.0)], "y int, p double")
    assert M.brier_skill(d, "p", "y").first()["bss"] == 1.0
    assert C.roc_auc(d, "p", "y").first()["auc"] is None
    assert C.average_precision(d, "p", "y").first()["ap"] == 1.0
    e = spark.createDataFrame([(i % 3, i % 3) for i in range(9)], "y int, yhat int")
    v = {r["metric"]: r["value"] for r in M.summary_metrics(e, "y", "yhat", 3).collect()}
    assert v["accuracy"] == 1 and v["mcc_rk"] == pytest.approx(1) and v["tss_macro"] == pytest.approx(1)


def test_offline_report_takes_both_spellings(spark):
    d = spark.createDataFrame([("M+", "M"), ("NONE", "C"), ("X", "M+"), ("NONE", "X")], "label string, label_pred string")
    v = {r["metric"]: r["value"] for r in M.prediction_report(d, scheme="binary", threshold="M").collect()}
    assert v["accuracy"] == 0.75 and v["tp"] == 2 and v["fp"] == 1


def test_binary_expected_score(spark):
    d = spark.createDataFrame([([0.9], 1), ([0.2], 0)], "p array<double>, y int")
    assert X.expected_score(d, "p", "y").first()["score"] == pytest.approx(0.7)


def test_hamming_with_empty_sets(spark):
    d = spark.createDataFrame([([0, 0], [0, 0]), ([1, 0], [1, 1])], "a array<int>, b array<int>")
    assert L.hamming_score(d, "a", "b").first()[0] == 0.75
    assert L.hamming_score(d, "a", "b", False).first()[0] == 0.5


def test_weights_with_empty_class(spark):
    d = spark.createDataFrame([(0,), (0,), (1,)], "y int")
    w = {r["y"]: r["weight"] for r in W.class_weights(d, "y", 3, "inverse_v2", normalize=False).collect()}
    assert w == {0: 1.0, 1: 2.0, 2: 2.0}


def test_across_runs_single_and_missing(spark):
    d = spark.createDataFrame([(1, "c", "train", "X", 4, 0.5), (2, "c", "train", "M", 2, 1.0)],
                              "run int, category string, split string, label string, n long, frac double")
    a = R.across_runs(d).where("metric = 'count' AND label = 'X'").first()
    assert (a["n"], a["std"], a["mean"]) == (1, 0.0, 4.0)
    b = R.across_runs(d, missing_as_zero=True).where("metric = 'count' AND label = 'X'").first()
    assert (b["n"], b["min"], b["median"]) == (2, 0.0, 2.0)


def test_readers_reject_bad_input(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": [{"x": 1}]}')
    with pytest.raises(ValueError):
        readers.read_datalist(spark, str(tmp_path / "a.json"))
    assert readers.read_datalist(spark, str(tmp_path / "a.json"), "rows").first()["x"] == 1
    for bad in ("", "x.txt", ["a.txt"]):
        with pytest.raises(ValueError):
            readers.read_any(spark, bad)
    assert readers.read_any(spark, ["/d/b.png", "/d/a.png"]).first()["filepaths"] == ["/d/b.png", "/d/a.png"]
    (tmp_path / "f.csv").write_text("1,2\n" + ",".join(["1"] * 29) + ",0,0,12_20240101_000000.fits\n"
                                    + ",".join(["x"] * 29) + ",0,0,12_20240101_000000.fits\n")
    rows = readers.read_feature_rows(spark, str(tmp_path / "f.csv")).collect()
    assert [r["error"] for r in rows] == ["short row", None, "feature"] and rows[1]["ar"] == 12


def test_summary_reader_fallback(spark, tmp_path):
    (tmp_path / "r1.txt").write_text("Label breakdown per NEW split:\n  [train] total=10\n    - NONE: 9 (90.00%)\n    - M+: 1 (10.00%)\n")
    got = {(r["split"], r["label"]): (r["n"], r["frac"]) for r in readers.read_split_summaries(spark, str(tmp_path)).collect()}
    assert got == {("train", "NONE"): (9, 0.9), ("train", "M+"): (1, 0.1)}


def test_flat_csv_digits(spark, tmp_path):
    d = spark.createDataFrame([("t", 0.5, 100.0, 1 / 3)], "t0 string, r1 double, r2 double, r3 double")
    writers.write_flat_windows(d, str(tmp_path / "w"))
    text = spark.read.text(str(tmp_path / "w")).collect()
    assert {r["value"] for r in text} == {"t0,r1,r2,r3", "t,0.5,100,0.3333333333"}
