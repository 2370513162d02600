"""Fits, bundles, features and scorer runs, checked by their properties."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from labelloom.operators import features as ft
from labelloom.operators import models as md
from labelloom.operators import scoring as sc
from labelloom.operators.prepare import index_labels
from labelloom.operators.split import holdout, kfold
from labelloom.operators.wordvectors import WordVectorModel
from labelloom.plans import modelling, streams
from labelloom.session import materialize

LABELS = ["fruta", "metal", "verbo"]
WORDS = {"fruta": "pera manzana uva higo", "metal": "hierro cobre zinc plomo", "verbo": "correr saltar comer dormir"}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(150):
        label = LABELS[0] if i % 2 else LABELS[1 + i % 4 // 2]
        words = WORDS[label].split()
        rows.append((i, f"{words[i % 4]} y {words[(i + 1) % 4]} con {words[(i * 7) % 4]} número {i % 9}", label))
    return holdout(spark.createDataFrame(rows, "doc_id int, text string, label string"), "label", "doc_id").cache()


@pytest.mark.parametrize("vec", ["one_hot", "bow", "tfidf", "tfidf_sublinear", "word2vec"])
def test_feature_tables_hold_every_row(corpus, vec):
    table = md.feature_table(corpus, vec, LABELS, "doc_id")
    assert table.count() == 150
    size = {len(r.a) for r in table.select(vector_to_array("features").alias("a")).collect()}
    assert len(size) == 1


@pytest.mark.parametrize("name", ["tfidf", "tfidf_sublinear"])
def test_vector_form_equals_long_form(corpus, name):
    table = md.feature_table(corpus, name, LABELS, "doc_id")
    terms = ft.term_counts(corpus, "doc_id", keep=["split"])
    vocab = materialize(ft.vocabulary(terms.where("split = 'train'")))
    n = corpus.where("split = 'train'").count()
    long = ft.tfidf(terms, vocab, "doc_id", n, sublinear=name == "tfidf_sublinear")
    a = {r.doc_id: sorted(round(x, 6) for x in r.a if x) for r in table.select("doc_id", vector_to_array("features").alias("a")).collect()}
    b = {}
    for r in long.collect():
        b.setdefault(r.doc_id, []).append(round(r.weight, 6))
    assert a == {k: sorted(x) for k, x in b.items()}


def test_smooth_idf_keeps_terms_of_all_documents(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa cc")], "id int, text string")
    terms = ft.term_counts(df, "id")
    got = {(r.id, r.term): r.weight for r in ft.tfidf(terms, materialize(ft.vocabulary(terms)), "id", 2).collect()}
    w = np.log(3 / 2) + 1
    assert got[1, "aa"] == pytest.approx(1 / np.hypot(1, w)) and got[1, "bb"] == pytest.approx(w / np.hypot(1, w))


def test_vocabulary_cut_is_deterministic(spark):
    df = spark.createDataFrame([(1, "bb aa cc cc")], "id int, text string")
    assert [r.term for r in ft.vocabulary(ft.term_counts(df, "id"), 2).collect()] == ["cc", "aa"]


def test_doc_vectors_skip_unknown_words(spark):
    from pyspark.ml.linalg import Vectors

    docs = spark.createDataFrame([(1, ["a", "b", "zz", "a"]), (2, ["zz"])], "id int, tokens array<string>")
    wv = spark.createDataFrame([("a", Vectors.dense([3.0, 0.0])), ("b", Vectors.dense([0.0, 6.0]))], ["term", "vector"])
    got = {r.id: list(r.doc_vector) for r in ft.doc_vectors(docs, "id", F.col("tokens"), wv, 2).collect()}
    assert got == {1: [2.0, 2.0], 2: [0.0, 0.0]}


@pytest.mark.parametrize("model, options", [("logreg", {}), ("svm", {}), ("rf", {"numTrees": 20})])
def test_models_learn_and_give_probabilities(corpus, model, options):
    table = md.feature_table(corpus, "tfidf", LABELS, "doc_id")
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    preds = md.predict(md.estimator(model, n_rows=train.count(), **options).fit(train), test, LABELS, "doc_id").collect()
    assert np.mean([r.true_label == r.pred_label for r in preds]) > 0.95
    assert all(sum(r.scores) == pytest.approx(1) for r in preds)
    # Scores follow the label order: the best score names the predicted label.
    assert all(sorted(LABELS)[int(np.argmax(r.scores))] == r.pred_label for r in preds)


def test_bundle_round_trip(spark, corpus, tmp_path):
    model = md.refit(corpus, LABELS, "tfidf", "logreg")
    md.save_bundle(model, {"n": 150}, str(tmp_path))
    loaded, meta = md.load_bundle(spark, str(tmp_path))
    a, b = (md.score(corpus, m, LABELS, "doc_id").orderBy("doc_id").collect() for m in (model, loaded))
    assert a == b and meta == {"n": 150}


def test_grid_and_best(corpus):
    out = md.run_grid(corpus, LABELS, "doc_id", ["bow", "tfidf"], ["logreg"])
    rows = {r.vectorizer: r for r in out.collect()}
    assert set(rows) == {"bow", "tfidf"}
    for r in rows.values():
        assert r.f1_macro > 0.95 and 0.99 < r.roc_auc_macro <= 1 and 0 <= r.log_loss < 0.7


def test_cv_predicts_every_row_once(corpus):
    folded = kfold(corpus.drop("split"), "label", "doc_id", 3)
    preds = md.cv_predictions(folded, LABELS, "doc_id", "bow", "logreg")
    assert preds.count() == preds.select("doc_id").distinct().count() == 150


def test_search_orders_trials(corpus):
    table = md.feature_table(corpus.where("label <> 'verbo'"), "bow", LABELS[:2], "doc_id").drop("split")
    folds = kfold(table.select("doc_id", "label"), "label", "doc_id", 2).select("doc_id", "fold")
    found = md.search(materialize(table.join(folds, "doc_id")), LABELS[:2], "doc_id", trials=6, families=("logreg",))
    assert [r["n_folds"] for r in found] == [2] * 6 and {r["trial"] for r in found} == set(range(6))
    assert all(a["score"] >= b["score"] for a, b in zip(found, found[1:]))
    assert all(r["params"] == md.draw_trial(r["trial"], families=("logreg",))[1] for r in found)
    assert found[0]["score"] > 0.95


def test_search_bounds_the_tree_fits(corpus, monkeypatch):
    fits = []
    monkeypatch.setattr(md, "draw_trial", lambda t, *a: ("gbt", {"maxIter": 3 - t, "maxDepth": 2}) if t else ("logreg", {"C": 1.0, "maxIter": 9}))
    real = md.fit
    monkeypatch.setattr(md, "fit", lambda est, train, n: fits.append(est.getMaxIter()) or real(est, train, n))
    table = md.feature_table(corpus.where("label <> 'verbo'"), "bow", LABELS[:2], "doc_id").drop("split")
    folds = kfold(table.select("doc_id", "label"), "label", "doc_id", 3).select("doc_id", "fold")
    found = md.search(materialize(table.join(folds, "doc_id")), LABELS[:2], "doc_id", trials=3, tree_trials=1, tree_folds=2, metric="accuracy")
    assert fits == [1, 1] and {(r["trial"], r["n_folds"]) for r in found} == {(0, 3), (2, 2)}


def test_search_query_refits_the_winner(spark, sf, monkeypatch):
    seen, real = {}, getattr(md, "refit_best", None)

    def ids(df):
        return {r.doc_id for r in df.select("doc_id").collect()}

    def search(table, labels, key, **options):
        seen["searched"] = ids(table)
        return [{"trial": 0, "model": "logreg", "params": {"C": 1.0, "maxIter": 5}, "score": 0.5, "n_folds": 3}]

    def refit_best(found, train, test, labels, key):
        seen["train"], out = ids(train), real(found, train, test, labels, key)
        seen["tested"] = ids(out)
        return out

    monkeypatch.setattr(md, "search", search)
    monkeypatch.setattr(md, "refit_best", refit_best, raising=False)
    row = modelling.hyperparam_search(spark, sf).first()
    split = {r.doc_id: r.split for r in modelling.toxic_table(spark, sf, "bow").select("doc_id", "split").collect()}
    assert seen["searched"] == seen["train"] == {k for k, s in split.items() if s == "train"}
    assert seen["tested"] == {k for k, s in split.items() if s == "test"}
    assert row.n_scored == len(split) and row.in_range


@pytest.mark.parametrize("name", ["experiment_grid", "cv_pipeline", "refit_full", "batch_score", "stream_score"])
def test_queries_fit_with_the_default_steps(spark, sf, monkeypatch, name):
    steps = []

    def fit(est, train, n_rows):
        last = est.getStages()[-1] if hasattr(est, "getStages") else est
        if isinstance(last, LogisticRegression):
            steps.append(last.getMaxIter())
        raise InterruptedError

    monkeypatch.setattr(md, "fit", fit)
    monkeypatch.setattr(modelling, "GRID_VECTORIZERS", ["bow"])
    with pytest.raises(InterruptedError):
        getattr(streams if name == "stream_score" else modelling, name)(spark, sf)
    assert steps and set(steps) == {1000}


def test_refit_query_chooses_among_all_cells(spark, sf, monkeypatch):
    def run_grid(df, labels, key, vectorizers, models, *a, **k):
        raise InterruptedError(len(vectorizers) * len(models))

    monkeypatch.setattr(md, "run_grid", run_grid)
    with pytest.raises(InterruptedError, match="12"):
        modelling.refit_full(spark, sf)


def test_word_vector_bundle_loads_in_a_new_session(spark, corpus, tmp_path):
    model = md.refit(corpus, LABELS, "word2vec", "logreg")
    path = str(tmp_path / "bundle")
    md.save_bundle(model, {"labels": LABELS}, path)
    want = sorted(map(tuple, md.score(corpus, model, LABELS, "doc_id").collect()))
    loaded, meta = md.load_bundle(spark.newSession(), path)
    got = sorted(map(tuple, md.score(corpus, loaded, meta["labels"], "doc_id").collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])


@pytest.mark.parametrize("sublinear", [False, True])
def test_weights_in_rows_equal_the_long_form(spark, corpus, sublinear):
    texts = corpus.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat("text", F.lit(" pera Pera"))).alias("text"))
    terms = materialize(ft.term_counts(texts, "doc_id"))
    vocab = materialize(ft.vocabulary(terms, 9))
    want = {(r.doc_id, r.term): r.weight for r in ft.tfidf(terms, vocab, "doc_id", 150, sublinear=sublinear).collect()}
    rows = ft.tfidf_rows(texts, "doc_id", vocab, 150, sublinear=sublinear)
    got = {(r.doc_id, r.term): r.weight for r in rows.select("doc_id", F.inline("cells")).collect()}
    assert got == pytest.approx(want) and want
    for r in ft.row_vectors(rows, "doc_id", vocab.count()).collect():
        assert r.features.norm(2) == pytest.approx(1) and r.features.size == 9 and (np.diff(r.features.indices) > 0).all()


def test_word_vector_means(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "term string, vector array<float>")
    rows = spark.createDataFrame([(1, ["a", "b", "a", "zz"]), (2, ["zz"]), (3, []), (4, None)], "id int, tokens array<string>")
    got = {r.id: r.features.toArray().tolist() for r in WordVectorModel(vectors=vectors).transform(rows).collect()}
    assert got == {1: [2 / 3, 1.0], 2: [0, 0], 3: [0, 0], 4: [0, 0]}
    # The join form gives the same means.
    joined = ft.doc_vectors(rows.where("id < 4"), "id", F.col("tokens"), vectors.select("term", array_to_vector("vector").alias("vector")), 2)
    for r in joined.collect():
        assert r.doc_vector.toArray().tolist() == pytest.approx(got[r.id])


def test_vectoriser_callbacks_are_stored(spark, corpus, tmp_path):
    fitted = md.fit(md.pipeline("tfidf", "logreg", n_rows=150, preprocess="regexp_replace(upper(text), '[0-9]+', '#')",
                                tokenize="filter(split(prepared, '[^A-Z#]+'), x -> length(x) > 0)"),
                    index_labels(corpus, LABELS, "label"), 150)
    words = set(fitted.stages[2].vocabulary)
    assert words and all(w == w.upper() for w in words)
    path = str(tmp_path / "bundle")
    md.save_bundle(fitted, {}, path)
    loaded, _ = md.load_bundle(spark, path)
    assert sorted(map(tuple, md.score(corpus, loaded, LABELS, "doc_id").collect())) == sorted(map(tuple, md.score(corpus, fitted, LABELS, "doc_id").collect()))


@pytest.mark.parametrize("cached", [False, True])
def test_null_texts_are_encoded_as_empty(spark, tmp_path, cached):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "some words")], "id int, text string")
    out = ft.encode_cached(rows, "id", "text", str(tmp_path / "c")) if cached else ft.encode(rows, "id", "text")
    got = {r.id: r.embedding for r in out.collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[2] and not any(got[1]) and any(got[3])


def test_weights_sum_to_rows(corpus):
    assert md.balanced_weights(corpus, "label").agg(F.sum("weight")).first()[0] == pytest.approx(150)


def test_encoder_and_its_cache(spark, corpus, tmp_path):
    path = str(tmp_path / "cache")
    texts = corpus.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "copia").otherwise(F.col("text")).alias("text"))
    first = {r.doc_id: r.embedding for r in ft.encode_cached(texts, "doc_id", "text", path).collect()}
    n = spark.read.parquet(path).count()
    again = {r.doc_id: r.embedding for r in ft.encode_cached(texts, "doc_id", "text", path).collect()}
    assert first == again and len(first) == 150
    assert n == spark.read.parquet(path).count() == texts.select("text").distinct().count()


def flaky_client():
    """Factory of a client that answers, but fails on prompts with a certain word."""
    def build():
        def answer(prompt):
            if "zinc" in prompt:
                raise RuntimeError("context length exceeded")
            return '{"predicted_label": "metal", "confidence": 0.9}'

        return answer

    return build


def test_failed_calls_end_in_the_fallback(spark):
    rows = spark.createDataFrame([(1, "hierro"), (2, "zinc"), (3, " ")], "doc_id int, text string")
    out = sc.classify_answers(rows, "doc_id", "text", flaky_client(), LABELS, {}, "verbo")
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1].predicted_label, got[1].attempts, got[1].parse_error) == ("metal", 1, False)
    assert (got[2].predicted_label, got[2].attempts, got[2].parse_error) == ("verbo", 3, True)
    assert (got[3].predicted_label, got[3].attempts, got[3].parse_error) == ("verbo", 0, False)
    assert got[3]["class_scores"] == pytest.approx({l: 1 / 3 for l in LABELS})
    assert len(got) == 3


def test_weights_do_not_depend_on_the_pieces_of_a_batch(spark, monkeypatch):
    """Rows weighed two at a time give what all at once give; texts without words have no row."""
    from labelloom.operators import features as ft

    rows = [(i, t) for i, t in enumerate(["aa bb aa", "", "bb cc", None, "cc cc cc dd", "aa dd", "!"])]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    vocab = ft.vocabulary(ft.term_counts(df, "id"), 10).cache()
    found = []
    for n in (100, 2):
        monkeypatch.setattr(ft, "PIECE_ROWS", n)
        found.append({(r.id, c.term): c.weight for r in ft.tfidf_rows(df, "id", vocab, 7).collect() for c in r.cells})
    assert found[0] == found[1] and {i for i, _ in found[0]} == {0, 2, 4, 5}


def test_words_are_taken_once_per_row(spark):
    """The pattern of the words stands once in the optimised plan: no filter takes them again."""
    from labelloom.operators import features as ft

    df = spark.createDataFrame([(1, "aa bb")], "id int, text string")
    plan = ft.term_counts(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_a_fit_reads_features_not_texts(corpus, monkeypatch):
    seen, real = [], md.fit
    monkeypatch.setattr(md, "fit", lambda est, train, n: seen.append(train) or real(est, train, n))
    md.refit(corpus, LABELS, "bow", "logreg")
    md.cv_predictions(kfold(corpus.drop("split"), "label", "doc_id", 2), LABELS, "doc_id", "tfidf", "logreg")
    plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in seen]
    assert len(plans) == 3 and all("features" in t.columns for t in seen)
    assert not any("text#" in p or "tokens#" in p for p in plans)


@pytest.mark.parametrize("rows", [modelling.split_docs, modelling.toxic_table])
def test_rows_are_cleaned_once(spark, sf, monkeypatch, rows):
    plans = []

    def stop(df, *a, **k):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(modelling, "materialize", stop)
    monkeypatch.setattr(modelling, "holdout", stop)
    with pytest.raises(InterruptedError):
        rows(spark, sf)
    assert plans[0].count("regexp_extract_all") == 1
