"""Readers, sinks, splits, resamples and planning."""

import hashlib

import pytest
from pyspark.sql import functions as F

from labelloom import domain
from labelloom.operators import dedup, planning as pl, prepare as pr, split as sp
from labelloom.sources import readers, sinks


def test_multiline_quotes_and_missing_marks(spark, tmp_path):
    path = tmp_path / "mails.csv"
    path.write_text('email_id;email_corpus;class_label\n1;"dice ""hola""\n\nfin; ok";a\n2;;b\n3;NA;c\n', encoding="utf-8")
    rows = readers.read_corpus(spark, str(path), sep=None, required=("email_corpus",)).orderBy("email_id").collect()
    assert [tuple(r) for r in rows] == [("1", 'dice "hola"\n\nfin; ok', "a"), ("2", None, "b"), ("3", None, "c")]
    assert readers.sniff_separator(spark, str(path)) == ";"
    with pytest.raises(ValueError, match="missing required"):
        readers.read_corpus(spark, str(path), required=("nope",))


def test_round_trip_of_awkward_text(spark, tmp_path):
    texts = [' lead', 'a"b;c\nd\\', "x\r\ny", "Ñ \\\" end\\"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sinks.write_corpus(df, str(tmp_path / "out"))
    back = readers.read_corpus(spark, str(tmp_path / "out"), missing_marks=())
    assert sorted((int(r.id), r.text) for r in back.collect()) == list(enumerate(texts))


def test_casts_turn_bad_values_into_null(spark):
    df = spark.createDataFrame([("true", "0.7", "x", "2024-05-01T10:00:00")], "is_spam string, top_p string, seed string, timestamp string")
    row = readers.cast_corpus(df).first()
    assert (row.is_spam, row.top_p, row.seed) == (True, 0.7, None) and row.timestamp.year == 2024


def test_guess_column():
    assert readers.guess_column(["id", "body_text", "label"], ["text", "label"], "label") == "body_text"
    assert readers.guess_column(["id"], ["text"]) is None


def test_header_normalisation(spark):
    df = spark.createDataFrame([(1, "x")], "` #Message ` int, `CLASS` string")
    assert pr.map_columns(pr.normalize_columns(df)).columns == ["text", "label"]


def test_holdout_is_exact_and_stable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("label"))
    out = sp.holdout(df, "label", "id")
    for r in out.groupBy("label").agg(F.count_if(F.col("split") == "test").alias("t"), F.count("*").alias("n")).collect():
        assert r.t == round(r.n * 0.3)
    again = sp.holdout(df.repartition(13), "label", "id")
    assert out.join(again, ["id", "split"]).count() == 1000


def test_folds_partition_rows_evenly(spark):
    df = spark.range(503).select("id", F.when(F.col("id") < 400, "hot").otherwise("cold").alias("label"))
    sizes = [(r["label"], r["fold"], r["count"]) for r in sp.kfold(df, "label", "id", 5).groupBy("label", "fold").count().collect()]
    assert sum(n for *_, n in sizes) == 503 and len(sizes) == 10
    for label in ("hot", "cold"):
        n = [c for l, _, c in sizes if l == label]
        assert max(n) - min(n) <= 1


def test_bootstrap_draws(spark):
    boot = sp.bootstrap(spark.range(200), "id", 3)
    for r in sp.bootstrap_sizes(boot).collect():
        assert r.n_draws == 200 and r.n_train + r.n_oob == 200 and 50 < r.n_oob < 95
    assert sp.bootstrap_sizes(sp.bootstrap(spark.range(1), "id", 2)).count() == 0
    assert sp.bootstrap_sizes(sp.bootstrap(spark.range(0), "id", 2)).count() == 0


def test_bootstrap_draws_by_position(spark, monkeypatch):
    monkeypatch.setattr(sp, "POSITIONS", 7)
    n, its = 60, 5
    got = {r.id: list(r.draws) for r in sp.bootstrap(spark.range(n), "id", its).collect()}
    ranked = sorted(range(n), key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
    drawn = [[int(hashlib.md5(f"{i}-{s}|boot42".encode()).hexdigest()[:15], 16) % n for s in range(n)] for i in range(its)]
    assert got == {k: [drawn[i].count(p) for i in range(its)] for p, k in enumerate(ranked)}


@pytest.mark.parametrize("n", [0, 40, 100, 250])
def test_resample_to_size(spark, n):
    out = sp.sample_to(spark.range(100), "id", n)
    assert (out.agg(F.sum("copies")).first()[0] or 0) == n


def test_few_shot_prefers_the_band_and_stops_at_the_total(spark):
    rows = [(i, l, ("x" * n)) for i, (l, n) in enumerate([("a", 60), ("a", 30), ("a", 700), ("b", 30), ("b", 20), ("c", 5), ("d", 100)])]
    df = spark.createDataFrame(rows, "id int, label string, text string")
    got = sp.few_shot(df, list("abcd"), "id", "text", "label", per_class=2).collect()
    assert sorted(r.id for r in got) == [0, 3, 4, 6]
    assert sorted(r.example_no for r in got) == [1, 2, 3, 4]
    capped = sp.few_shot(df, list("abcd"), "id", "text", "label", per_class=1, max_total=2).collect()
    assert sorted(r.label for r in capped) == ["a", "b"]
    assert "Ejemplo 1:" in sp.few_shot_block(sp.few_shot(df, list("abcd"), "id", "text", "label")).first().examples


def test_dedup_keeps_first_of_a_hot_text(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = dedup.dedup_first(df, "text", "id")
    assert out.count() == 201 and out.where("text = 'same'").first().id == 0


def test_label_index(spark):
    df = spark.createDataFrame([("spam",), ("amigo",), ("spam",)], "label string")
    assert {(r.label, r.label_index) for r in pr.index_labels(df, ["spam", "amigo"], "label", "spam").collect()} == {("spam", 1), ("amigo", 0)}


def test_plan_shares_follow_the_weights(spark):
    plan = pl.corpus_plan(spark.range(20_000), "id")
    n = {r.class_label: r["count"] for r in plan.groupBy("class_label").count().collect()}
    assert set(n) == set(domain.LABELS)
    total = sum(w for _, w in domain.WEIGHTS)
    assert n["factura_error"] / 20_000 == pytest.approx(0.08 / total, abs=0.01)
    row = plan.agg(
        F.avg((F.col("secondary_label").isNotNull()).cast("int")).alias("multi"),
        F.count_if(F.col("secondary_label") == F.col("class_label")).alias("clash"),
        F.count_if(F.col("is_ambiguous") & F.col("is_multi_intent")).alias("both"),
        F.min("temperature").alias("t0"), F.max("temperature").alias("t1"), F.min("top_k").alias("k0"), F.max("top_k").alias("k1"),
    ).first()
    assert row.multi == pytest.approx(0.2, abs=0.01) and row.clash == 0 and row.both == 0
    assert 0.65 <= row.t0 and row.t1 <= 1.05 and (row.k0, row.k1) == (30, 79)


def test_grid_is_in_product_order(spark):
    grid = pl.param_grid(spark, {"a": ["x", "y"], "b": ["1", "2", "3"]}, 4).orderBy("combo").collect()
    assert [(r.a, r.b) for r in grid] == [("x", "1"), ("x", "2"), ("x", "3"), ("y", "1")]
    assert len(domain.LABELS) == len(set(domain.LABELS)) == 35
