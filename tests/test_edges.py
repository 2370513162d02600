"""Nulls, empty tables, one-sided classes, string keys and large counts."""

import math

import pytest
from pyspark.sql import functions as F

from labelloom.functions.keys import draw
from labelloom.operators import features as ft
from labelloom.operators import metrics as mt
from labelloom.operators import models as md
from labelloom.operators import ordering as od
from labelloom.operators import profile as pf
from labelloom.operators import scoring as sc
from labelloom.operators import split as sp
from labelloom.operators import timeseries as ts
from labelloom.plans.catalog import QUERIES
from labelloom.streaming import scoring as ss
from labelloom.streaming import series as sr


def test_draw_reaches_rows_beyond_32_bits(spark):
    n = 20_000_000_000
    top = spark.range(20_000).agg(F.max(draw("id", "x") % n)).first()[0]
    assert top > 0.999 * n


def test_missing_prediction_is_wrong(spark):
    rows = spark.createDataFrame([(1, "a", "a"), (2, "a", None), (3, "a", "b"), (4, "b", None)], "row_id int, true_label string, pred_label string")
    assert mt.accuracy(rows).first().accuracy == 0.25


def test_one_sided_class_gives_nan(spark):
    rows = spark.createDataFrame([(1, "a", "a", 0.9), (1, "a", "z", 0.1)], "row_id int, true_label string, label string, score double")
    ap = {r.label: r.average_precision for r in mt.avg_precision(rows).collect()}
    assert ap["a"] == 1.0 and math.isnan(ap["z"])
    assert any(math.isnan(r.recall) for r in mt.pr_points(rows).collect())
    assert all(math.isnan(r.fpr) for r in mt.roc_points(rows).collect() if r.label == "a")


def test_log_loss_of_zero_scores_is_uniform(spark):
    rows = spark.createDataFrame([(1, "a", "a", 0.0), (1, "a", "b", 0.0)], "row_id int, true_label string, label string, score double")
    assert abs(mt.log_loss(rows).first().log_loss - math.log(2)) < 1e-12


def test_auc_of_very_large_counts(spark):
    steps = spark.createDataFrame([("a", 4 * 10**9, 0, 4 * 10**9, 0), ("a", 0, 4 * 10**9, 4 * 10**9, 4 * 10**9)],
                                  "label string, pos long, neg long, tp long, fp long")
    steps = steps.withColumns({"tp_total": F.lit(4 * 10**9), "fp_total": F.lit(4 * 10**9)})
    assert mt.auc_from_steps(steps).first().auc == 1.0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, flag boolean, model string, kind string")
    assert pf.flag_rates(none, ["flag"]).first().share is None
    assert pf.store_stats(none, "flag", "model", "kind").first().success_rate is None
    assert sp.sample_to(none, "id", 5).count() == 0


def test_null_confidences_are_in_no_bin(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", None)], "g string, c double")
    assert sum(r.n for r in mt.histogram(rows, "c", "g", 4).collect()) == 2


def test_missing_sample_smooths_to_nothing(spark):
    rows = spark.createDataFrame([(1, t, x) for t, x in enumerate([1.0, None, 3.0, 4.0, 5.0])], "s int, t long, x double")
    got = [r.smoothed for r in ts.smooth(rows, "s", "t", "t", "x", 3).orderBy("pos").collect()]
    assert got[:3] == [None, None, None] and abs(got[3] - 4.0) < 1e-9


def test_ranks_of_string_keys(spark):
    keys = [f"{i * 7919 % 1000:04d}-x" for i in range(1000)]
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: r["rank"] for r in od.position_rank(rows, [], "k").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_class_missing_from_the_train_part(spark):
    rows = [(i, f"{'one' if i % 2 else 'two'} word{i % 5}", "a" if i % 2 else "b", i % 3) for i in range(60)]
    rows += [(100, "three words", "c", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, fold int")
    preds = md.cv_predictions(df, ["a", "b", "c"], "doc_id", "bow", "logreg", maxIter=5)
    out = {r.fold: r for r in md.evaluate_folds(preds, ["a", "b", "c"], "doc_id").collect()}
    assert set(out) == {-1, 0, 1, 2} and out[-1].n == 61 and out[-1].accuracy > 0.9


def test_encoder_cache_knows_its_encoder(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a text"), (2, "a text")], "id long, text string")
    path = str(tmp_path / "cache")
    assert {len(r.embedding) for r in ft.encode_cached(rows, "id", "text", path).collect()} == {64}
    wide = ft.encode_cached(rows, "id", "text", path, lambda: ft.HashedEncoder(128)).collect()
    assert [len(r.embedding) for r in wide] == [128, 128]
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    assert ft.encode_cached(rows, "id", "text", path + "2").count() == 2


def test_weights_count_for_every_model():
    for name in ("logreg", "svm", "rf", "gbt"):
        assert md.estimator(name, weight="weight", n_rows=10).getWeightCol() == "weight"
    assert md.estimator("logreg", n_rows=10).getStandardization() is False


def test_only_errors_of_length_shorten(spark):
    def failing_client():
        def answer(prompt):
            if "long" in prompt and "[TRUNCADO]" not in prompt:
                raise TimeoutError("timed out")
            if "example" in prompt:
                return "no json"
            return '{"predicted_label": "a", "confidence": 0.9}'

        return answer

    rows = spark.createDataFrame([(1, "long " * 300), (2, "short")], "id long, text string")
    template = "{labels} {text}"
    got = {r.id: r for r in sc.classify_answers(rows, "id", "text", failing_client, ["a", "b"], {}, "b", template).collect()}
    assert (got[1].predicted_label, got[1].attempts) == ("a", 2) and got[2].attempts == 1
    got = {r.id: r for r in sc.classify_answers(rows, "id", "text", failing_client, ["a", "b"], {}, "b", template + "{examples}", examples="example").collect()}
    # Shortened prompts are zero-shot, so they carry no examples; the other prompt stays unreadable.
    assert got[1].predicted_label == "a" and (got[2].predicted_label, got[2].attempts, got[2].parse_error) == ("b", 3, True)


def test_text_queries_read_no_labels(spark, sf):
    plan = QUERIES["clean_text_latin"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_running_results_of_an_empty_stream_and_a_restart(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "true_label string, pred_label string"
    spark.createDataFrame([], schema).write.parquet(src)
    stream = lambda: sr.read_stream(spark, src, spark.createDataFrame([], schema).schema)
    assert ss.stream_confusion(stream(), out).count() == 0
    for n in (1, 2):
        spark.createDataFrame([("a", "b")] * 3, schema).write.mode("append").parquet(src)
        assert [tuple(r) for r in ss.stream_confusion(stream(), out).collect()] == [("a", "b", 3 * n)]


def test_merged_results_survive_a_restart(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    start = spark.createDataFrame([(1, 0), (2, 0)], "k long, v long")
    for i, rows in enumerate([[(2, 5)], [(3, 6), (1, 7)]]):
        spark.createDataFrame(rows, "k long, v long").write.mode("append").parquet(src)
        got = ss.foreach_merge(sr.read_stream(spark, src, start.schema), start, ["k"], out)
        assert sorted(map(tuple, got.collect())) == [[(1, 0), (2, 5)], [(1, 7), (2, 5), (3, 6)]][i]


@pytest.mark.parametrize("name", ["stream_resample", "stream_sessions", "stream_run_summary"])
def test_streams_cover_every_event(spark, sf, name):
    total = spark.read.parquet(f"{sf}/events.parquet").count()
    assert QUERIES[name](spark, sf).agg(F.sum("n_samples")).first()[0] == total
