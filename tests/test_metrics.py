"""Metrics against hand-computed figures and plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import metrics as mt


@pytest.fixture(scope="module")
def preds(spark):
    rows = [("a", "a")] * 6 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "a")] + [("c", "a")]
    return spark.createDataFrame(rows, "true_label string, pred_label string")


def test_class_report_with_absent_class(preds):
    got = {r.label: r for r in mt.class_report(preds, ["a", "b", "c", "d"]).collect()}
    assert got["a"].precision == pytest.approx(6 / 8) and got["a"].recall == pytest.approx(6 / 8)
    assert (got["c"].precision, got["c"].f1, got["d"].f1, got["d"].support) == (0.0, 0.0, 0.0, 0)
    f1 = [got[x].f1 for x in "abcd"]
    assert got["macro avg"].f1 == pytest.approx(sum(f1) / 4)
    assert got["weighted avg"].f1 == pytest.approx((f1[0] * 8 + f1[1] * 4 + f1[2]) / 13)
    assert got["accuracy"].f1 == pytest.approx(9 / 13) and got["accuracy"].support == 13


def test_report_agrees_with_prf(preds):
    row = mt.prf(preds, ["a", "b", "c"]).first()
    got = {r.label: r for r in mt.class_report(preds, ["a", "b", "c"]).collect()}
    assert row.f1_macro == pytest.approx(got["macro avg"].f1)
    assert row.recall_weighted == pytest.approx(got["weighted avg"].recall) == pytest.approx(row.accuracy)


def test_confusion_is_square_and_normalised(preds):
    conf = mt.confusion_norm(preds, ["a", "b", "c", "d"])
    assert conf.count() == 16
    shares = {r.true_label: r.s for r in conf.groupBy("true_label").agg(F.sum("share").alias("s")).collect()}
    assert shares == {"a": pytest.approx(1), "b": pytest.approx(1), "c": pytest.approx(1), "d": 0.0}


def test_observed_labels(preds):
    assert mt.observed_labels(preds) == ["a", "b", "c"]


@pytest.fixture(scope="module")
def binary(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 500)
    p = np.clip(np.round(rng.normal(0.4 + 0.2 * y, 0.2), 2), 0.01, 0.99)  # many ties
    p[:170] = 0.5  # a third of the rows share one score
    return y, p, spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")


def test_binary_metrics(binary):
    y, p, df = binary
    got = mt.binary_metrics(df, "y", "p").first()
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > neg).mean() + 0.5 * (a == neg).mean() for a in pos])
    assert got.roc_auc == pytest.approx(auc)
    ap, seen = 0.0, 0
    for s in sorted(set(p), reverse=True):
        hits = (y[p == s]).sum()
        seen += hits
        ap += hits / y.sum() * seen / (p >= s).sum()
    assert got.average_precision == pytest.approx(ap)
    assert got.log_loss == pytest.approx(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))
    hat = p >= 0.5
    assert got.precision == pytest.approx(y[hat].mean()) and got.recall == pytest.approx(hat[y == 1].mean())
    assert got.accuracy == pytest.approx((hat == y).mean())


def test_auc_is_nan_when_a_class_is_absent(spark):
    rows = [(i, "a" if i % 2 else "b", l, 0.1 * i) for i in range(6) for l in "abc"]
    scores = spark.createDataFrame(rows, "row_id int, true_label string, label string, score double")
    assert math.isnan(mt.roc_auc(scores, list("abc")).first().roc_auc_macro)
    assert not math.isnan(mt.roc_auc(scores, list("ab")).first().roc_auc_macro)


def test_log_loss_aligns_by_name_and_clips(spark):
    rows = [(1, "z", "z", 1.0), (1, "z", "a", 0.0), (2, "a", "z", 3.0), (2, "a", "a", 1.0)]
    scores = spark.createDataFrame(rows, "row_id int, true_label string, label string, score double")
    assert mt.log_loss(scores).first().log_loss == pytest.approx(-math.log(0.25) / 2, abs=1e-9)


def test_fold_summary_counts_folds(spark):
    rows = [(f, "a", "a" if f < 2 else "b") for f in range(3) for _ in range(4)]
    df = spark.createDataFrame(rows, "fold int, true_label string, pred_label string")
    fm = mt.fold_metrics(df, ["a", "b"])
    assert sorted(r.fold for r in fm.collect()) == [-1, 0, 1, 2]
    acc = {r.metric: r for r in mt.fold_summary(fm).collect()}["accuracy"]
    assert acc["mean"] == pytest.approx(2 / 3) and acc["std"] == pytest.approx(np.std([1, 1, 0])) and acc["n_folds"] == 3


def test_histogram_density_integrates_to_one(binary):
    _, _, df = binary
    out = mt.histogram(df, "p", "y").groupBy("y").agg(F.sum("n").alias("n"), F.sum(F.col("density")).alias("d"))
    spans = {r.y: r.hi - r.lo for r in df.groupBy("y").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).collect()}
    for r in out.collect():
        assert r.d * spans[r.y] / 40 == pytest.approx(1)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(True, 0.5), (True, 0.5)], "g boolean, p double")
    row = mt.histogram(df, "p", "g").first()
    assert (row.bin, row.n) == (0, 2)
