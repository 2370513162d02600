"""Registered queries: term features, word vectors, encoders and distributed models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from labelloom import domain
from labelloom.functions import text as tx
from labelloom.functions.answers import fixed
from labelloom.functions.keys import uniform
from labelloom.operators import features as ft
from labelloom.operators import metrics as mt
from labelloom.operators import models as md
from labelloom.operators.cbow import cbow
from labelloom.operators.split import holdout, kfold
from labelloom.plans import views as v
from labelloom.plans.registry import query
from labelloom.session import materialize, scratch_path

N_TERMS = domain.MAX_TERMS


def split_docs(spark, d):
    """(doc_id, text, label, split): cleaned documents with a 30 % test part per language."""
    rows = v.texts(spark, d).select("doc_id", F.col("text").alias("raw"), F.col("lang").alias("label"))
    docs = fixed(rows, text=tx.clean_latin("raw")).drop("raw")
    return holdout(materialize(docs.where(F.col("text") != ""), "clean"), "label", "doc_id")


SPLIT = f"""docs AS (SELECT doc_id, {v.s_clean_latin("text")} AS text, lang AS label FROM documents),
  sp AS (SELECT *, CASE WHEN {v.s_rank("label", "doc_id")} <= round(count(*) OVER (PARTITION BY label) * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split
    FROM docs WHERE text <> ''),
  tok AS (SELECT doc_id, split, unnest({v.s_words("text")}) AS term FROM sp),
  tf AS (SELECT doc_id, split, term, count(*) AS tf FROM tok GROUP BY ALL),
  vocab AS (SELECT term, cast(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf WHERE split = 'train' GROUP BY term ORDER BY cf DESC, term LIMIT {N_TERMS}),
  ntrain AS (SELECT count(*) AS n FROM sp WHERE split = 'train')"""


def train_terms(spark, d):
    """Term counts of all rows and the vocabulary of the train rows, each written once."""
    rows = split_docs(spark, d)
    terms = materialize(ft.term_counts(rows, "doc_id", keep=["split"]), "terms")
    train = terms.where("split = 'train'")
    vocab = materialize(ft.vocabulary(train, N_TERMS), "vocab")
    return terms.drop("split"), vocab, rows.where("split = 'train'").count()


@query("vocab_top_n", f"WITH {SPLIT} SELECT term, cf, df FROM vocab")
def vocab_top_n(spark, d):
    rows = split_docs(spark, d).where("split = 'train'")
    return ft.vocabulary(ft.term_counts(rows, "doc_id"), N_TERMS)


@query("bow_counts", f"WITH {SPLIT} SELECT doc_id, term, tf FROM tf JOIN vocab USING (term)")
def bow_counts(spark, d):
    terms, vocab, _ = train_terms(spark, d)
    return ft.bow(terms, vocab, "doc_id")


@query("one_hot_terms", f"WITH {SPLIT} SELECT doc_id, term, 1 AS present FROM tf JOIN vocab USING (term)")
def one_hot_terms(spark, d):
    terms, vocab, _ = train_terms(spark, d)
    return ft.one_hot(terms, vocab, "doc_id")


def _tfidf_sql(tf: str) -> str:
    return f"""WITH {SPLIT}, w AS (SELECT doc_id, term, {tf} * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term), ntrain),
  nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
  SELECT doc_id, term, round(w / norm, 6) AS weight FROM w JOIN nrm USING (doc_id)"""


def _weights(spark, d, sublinear):
    rows = split_docs(spark, d)
    train = rows.where("split = 'train'")
    vocab = materialize(ft.vocabulary(ft.term_counts(train, "doc_id"), N_TERMS), "vocab")
    cells = ft.tfidf_rows(rows, "doc_id", vocab, train.count(), sublinear=sublinear)
    return cells.select("doc_id", F.inline("cells")).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_smooth_l2", _tfidf_sql("tf::DOUBLE"))
def tfidf_smooth_l2(spark, d):
    return _weights(spark, d, False)


@query("tfidf_sublinear", _tfidf_sql("(ln(tf) + 1)"))
def tfidf_sublinear(spark, d):
    return _weights(spark, d, True)


@query("word2vec_fit", f"""WITH {SPLIT}, w AS (SELECT unnest(string_split(text, ' ')) AS word FROM sp WHERE split = 'train')
  SELECT word, 100 AS size, TRUE AS finite, TRUE AS moved FROM w GROUP BY word HAVING count(*) >= 2""")
def word2vec_fit(spark, d):
    """Bag-of-words vectors fitted on the train rows: the words seen twice or more, each with a finite vector of its own."""
    rows = split_docs(spark, d).where("split = 'train'").select(F.split("text", " ").alias("tokens"))
    x = F.col("vector")
    finite = F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) < 1e6))
    return cbow(rows, "tokens").select(F.col("term").alias("word"), F.size(x).alias("size"), finite.alias("finite"), F.exists(x, lambda v: v != 0).alias("moved"))


@query("doc_vector_mean", f"""WITH docs AS (SELECT doc_id, {v.s_clean_latin("text")} AS text FROM documents),
  tok AS (SELECT doc_id, unnest({v.s_blank_tokens("text")}) AS term FROM docs), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
  wv AS (SELECT term, {v.u("term", "a")} AS a, {v.u("term", "b")} - 0.5::DOUBLE AS b, {v.u("term", "c")} * 2 AS c FROM tf GROUP BY term HAVING sum(tf) >= 2),
  m AS (SELECT doc_id, sum(a * tf) / sum(tf) AS a, sum(b * tf) / sum(tf) AS b, sum(c * tf) / sum(tf) AS c FROM tf JOIN wv USING (term) GROUP BY doc_id)
  SELECT doc_id, round(coalesce(a, 0), 6) AS a, round(coalesce(b, 0), 6) AS b, round(coalesce(c, 0), 6) AS c FROM documents LEFT JOIN m USING (doc_id)""")
def doc_vector_mean(spark, d):
    """Document means over given word vectors: three keyed components per word seen at least twice."""
    docs = materialize(v.texts(spark, d).select("doc_id", tx.tokens(tx.clean_latin("text")).alias("tokens")), "tokens")
    terms = ft.term_counts(docs, "doc_id", tokens=F.col("tokens"))
    words = terms.groupBy("term").agg(F.sum("tf").alias("cf")).where("cf >= 2")
    parts = F.array(uniform("term", "a"), uniform("term", "b") - 0.5, uniform("term", "c") * 2)
    wv = materialize(words.select("term", array_to_vector(parts).alias("vector")), "word-vectors")
    out = ft.doc_vectors(docs, "doc_id", F.col("tokens"), wv, 3).withColumn("x", vector_to_array("doc_vector"))
    return out.select("doc_id", *[F.round(F.col("x")[i], 6).alias(n) for i, n in enumerate("abc")])


@query("encode_batches", f"""WITH sq AS (SELECT doc_id, {v.s_squeeze("text")} AS text FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({v.s_words("text")}) AS term FROM sq) GROUP BY ALL),
  terms AS (SELECT DISTINCT term, md5(term) AS m FROM tf), bits AS (SELECT term, j, ((('0x' || substr(m, j // 4 + 1, 1))::INTEGER >> (3 - j % 4)) & 1) * 2 - 1 AS s FROM terms, range(64) t(j)),
  x AS (SELECT doc_id, j, cast(sum(tf * s) AS BIGINT) AS x FROM tf JOIN bits USING (term) GROUP BY doc_id, j)
  SELECT doc_id, cast(j AS INTEGER) AS dim, round(cast(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS FLOAT)::DOUBLE, 4) AS value FROM x
  UNION ALL SELECT doc_id, cast(j AS INTEGER), 0 FROM documents ANTI JOIN tf USING (doc_id), range(64) t(j)""")
def encode_batches(spark, d):
    """Embeddings of all documents, encoded once per distinct text through the cache."""
    docs = v.texts(spark, d).select("doc_id", tx.squeeze("text").alias("text"))
    out = ft.encode_cached(docs, "doc_id", "text", scratch_path(spark, "encoder-cache"))
    long = out.select("doc_id", F.posexplode("embedding").alias("dim", "x"))
    return long.select("doc_id", "dim", F.round(F.col("x").cast("double"), 4).alias("value"))


def _fit_and_predict(spark, d, model, vec="tfidf", **params):
    table = md.feature_table(split_docs(spark, d), vec, v.LANGS, "doc_id", N_TERMS)
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    n = train.count()
    fitted = md.fit(md.estimator(model, n_rows=n, **params), train, n)
    return md.predict(fitted, test, v.LANGS, "doc_id")


def _shown(preds, labels, least, key="doc_id"):
    """Test rows with what must hold for each: scores that add up to one, the answer the best of them; and for all: the macro
    F1 on the test rows, given as ``least`` where it is that or more."""
    preds = materialize(preds, "shown")
    ordered = F.array(*[F.lit(l) for l in sorted(labels)])
    best = F.element_at(F.col("scores"), F.array_position(ordered, F.col("pred_label")).cast("int"))
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    reached = mt.prf(preds, labels).first()["f1_macro"]
    return preds.select(key, "true_label", F.size("scores").alias("n_scores"), F.round(total, 6).alias("score_sum"),
                        (best >= F.array_max("scores") - 1e-9).alias("best_wins"), F.lit(round(min(least, reached), 4)).alias("f1_macro"))


def shown_sql(rows: str, n: int, least: float) -> str:
    """The same columns for the test rows of ``rows``."""
    return (f"SELECT doc_id, label AS true_label, {n} AS n_scores, 1::DOUBLE AS score_sum, TRUE AS best_wins, "
            f"{least}::DOUBLE AS f1_macro FROM {rows} WHERE split = 'test'")


LEAST_F1 = {"logreg": 0.9, "svm": 0.9, "rf": 0.9, "gbt": 0.55}  # macro F1 that a fit must reach on the test rows


@query("train_logreg", f"WITH {SPLIT} {shown_sql('sp', len(v.LANGS), LEAST_F1['logreg'])}")
def train_logreg(spark, d):
    return _shown(_fit_and_predict(spark, d, "logreg"), v.LANGS, LEAST_F1["logreg"])


@query("train_linear_margin", f"WITH {SPLIT} {shown_sql('sp', len(v.LANGS), LEAST_F1['svm'])}")
def train_linear_margin(spark, d):
    return _shown(_fit_and_predict(spark, d, "svm"), v.LANGS, LEAST_F1["svm"])


@query("train_random_forest", f"WITH {SPLIT} {shown_sql('sp', len(v.LANGS), LEAST_F1['rf'])}")
def train_random_forest(spark, d):
    return _shown(_fit_and_predict(spark, d, "rf"), v.LANGS, LEAST_F1["rf"])


def toxic_table(spark, d, vec="tfidf_sublinear"):
    """Binary track: spam-style cleaning, toxic flag as label, feature table with split and weight."""
    docs = fixed(v.texts(spark, d).select("doc_id", F.col("text").alias("raw")), text=tx.clean_spam("raw")).drop("raw")
    flags = v.table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows = docs.join(flags, "doc_id").where(F.col("text") != "")
    return md.feature_table(holdout(rows, "label", "doc_id", 0.2), vec, [0, 1], "doc_id", N_TERMS)


TOXIC = f"""td AS (SELECT doc_id, {v.s_clean_spam("text")} AS text, toxic AS label FROM documents JOIN labels USING (doc_id)),
  tsp AS (SELECT *, CASE WHEN {v.s_rank("label", "doc_id")} <= round(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split
    FROM td WHERE text <> '')"""


@query("train_gbt_binary", f"WITH {TOXIC} {shown_sql('tsp', 2, LEAST_F1['gbt'])}")
def train_gbt_binary(spark, d):
    """Boosted trees at the library's defaults on class-balanced weights."""
    table = toxic_table(spark, d)
    train = md.balanced_weights(table.where("split = 'train'"), "label")
    fitted = md.fit(md.estimator("gbt", weight="weight"), train, train.count())
    return _shown(md.predict(fitted, table.where("split = 'test'"), [0, 1], "doc_id"), [0, 1], LEAST_F1["gbt"])


@query("class_weights", """SELECT doc_id, lang, round(count(*) OVER () / ((SELECT count(DISTINCT lang) FROM documents) * count(*) OVER (PARTITION BY lang)::DOUBLE), 6) AS weight FROM documents""")
def class_weights(spark, d):
    docs = v.documents(spark, d).select("doc_id", "lang")
    return md.balanced_weights(docs, "lang").withColumn("weight", F.round("weight", 6))


TRIALS, SEARCH_FOLDS = 30, 10


def _trials_sql() -> str:
    drawn = {t: md.draw_trial(t) for t in range(TRIALS)}
    rows = ", ".join(f"({t}, '{family}', {s_params(params)}, {SEARCH_FOLDS})" for t, (family, params) in drawn.items())
    return f"(VALUES {rows}) t(trial, model, params, n_folds)"


def s_params(params: dict) -> str:
    return v.s_quote(str(sorted(params.items())))


@query("hyperparam_search", f"""WITH {TOXIC}, n AS (SELECT cast(count(*) AS BIGINT) AS n FROM tsp)
  SELECT trial, model, params, n_folds, n AS n_scored, TRUE AS in_range, TRUE AS best_first FROM {_trials_sql()}, n""")
def hyperparam_search(spark, d):
    """Random search on the binary track by mean macro F1 over folds of the train rows; the winner is refitted on them
    and scores the test rows, so that every row is scored once per trial or by the winner.

    ``TRIALS`` drawn points, each with the parameters it drew, on all folds.
    """
    table = toxic_table(spark, d, "bow")
    train, test = table.where("split = 'train'").drop("split"), table.where("split = 'test'")
    folds = materialize(kfold(train.select("doc_id", "label"), "label", "doc_id", SEARCH_FOLDS).select("doc_id", "fold"), "folds")
    train = materialize(train.join(folds, "doc_id"), "search")
    found = md.search(train, [0, 1], "doc_id", trials=TRIALS)
    preds = materialize(md.refit_best(found, train, test, [0, 1], "doc_id"), "winner")
    reached = mt.prf(preds, [0, 1]).first()["f1_macro"]
    n = train.count() + preds.count()
    rows = [(r["trial"], r["model"], str(sorted(r["params"].items())), r["n_folds"], n, 0.0 <= r["score"] <= 1.0 and 0.0 <= reached <= 1.0,
             all(r["score"] <= x["score"] for x in found[:i])) for i, r in enumerate(found)]
    return spark.createDataFrame(rows, "trial int, model string, params string, n_folds int, n_scored long, in_range boolean, best_first boolean")


GRID_VECTORIZERS, GRID_MODELS = ["one_hot", "bow", "tfidf", "word2vec"], ["logreg", "svm", "rf"]
METRIC_FLAGS = [f"{m}_macro" for m in ("precision", "recall", "f1", "roc_auc")] + ["accuracy", "f1_weighted"]


def _in_range(columns):
    ok = None
    for c in columns:
        one = F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))
        ok = one if ok is None else ok & one
    return ok


@query("experiment_grid", f"""WITH {SPLIT}, t AS (SELECT count(*) AS n FROM sp WHERE split = 'test')
  SELECT vectorizer, model, n, TRUE AS in_range, TRUE AS finite_loss
  FROM (SELECT unnest({GRID_VECTORIZERS}) AS vectorizer), (SELECT unnest({GRID_MODELS}) AS model), t""")
def experiment_grid(spark, d):
    """The whole grid, four vectorisers x three models: one metric row each."""
    out = md.run_grid(split_docs(spark, d), v.LANGS, "doc_id", GRID_VECTORIZERS, GRID_MODELS, N_TERMS, parallelism=4)
    return out.select("vectorizer", "model", "n", _in_range(METRIC_FLAGS).alias("in_range"),
                      (F.col("log_loss") < 40.0).alias("finite_loss"))


CV_FOLDS = 5


@query("cv_pipeline", f"""WITH {SPLIT}, f AS (SELECT cast(({v.s_rank("label", "doc_id")} - 1 + dense_rank() OVER (ORDER BY label) - 1) % {CV_FOLDS} AS INTEGER) AS fold FROM sp),
  n AS (SELECT fold, count(*) AS n FROM f GROUP BY fold UNION ALL SELECT -1, count(*) FROM f) SELECT fold, n, TRUE AS in_range, TRUE AS beats_majority FROM n""")
def cv_pipeline(spark, d):
    """Vectoriser and model refitted inside every fold: scores, AUC and log loss per fold and pooled (fold -1)."""
    docs = split_docs(spark, d).drop("split")
    folded = kfold(docs, "label", "doc_id", CV_FOLDS)
    preds = md.cv_predictions(folded, v.LANGS, "doc_id", "tfidf", "logreg", n_terms=N_TERMS, parallelism=3)
    common = docs.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0] or 0.0
    out = md.evaluate_folds(preds, v.LANGS, "doc_id")
    return out.select("fold", "n", _in_range(METRIC_FLAGS).alias("in_range"), (F.col("accuracy") > common).alias("beats_majority"))


RESULTS_SQL = """res AS (SELECT source AS model, lang AS vectorizer, count(*) AS n, round(avg(n_chars), 6) AS f1_macro FROM documents GROUP BY ALL)"""


def result_table(spark, d):
    """A result-shaped table: a score per (source, language)."""
    return v.documents(spark, d).groupBy(F.col("source").alias("model"), F.col("lang").alias("vectorizer")).agg(
        F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("f1_macro"))


@query("best_per_model", f"WITH {RESULTS_SQL} SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1_macro DESC, vectorizer) = 1")
def best_per_model(spark, d):
    return mt.best(result_table(spark, d), ["model"], "f1_macro", "vectorizer")


@query("refit_full", f"""WITH {SPLIT} SELECT doc_id, label, TRUE AS known, (SELECT count(*) FROM sp) AS n FROM sp""")
def refit_full(spark, d):
    """Best combination of the whole grid by held-out macro F1, refitted on all rows, stored and read back."""
    rows = split_docs(spark, d)
    grid = md.run_grid(rows, v.LANGS, "doc_id", GRID_VECTORIZERS, GRID_MODELS, N_TERMS, parallelism=4)
    top = grid.orderBy(F.desc("f1_macro"), "vectorizer", "model").first()
    path = scratch_path(spark, "best")
    meta = {"vectorizer": top["vectorizer"], "model": top["model"], "f1_macro": top["f1_macro"], "n": rows.count()}
    md.save_bundle(md.refit(rows, v.LANGS, top["vectorizer"], top["model"], N_TERMS), meta, path)
    model, meta = md.load_bundle(spark, path)
    out = md.score(rows, model, v.LANGS, "doc_id", extra=["label"])
    return out.select("doc_id", "label", F.col("pred_label").isin(v.LANGS).alias("known"), F.lit(meta["n"]).cast("bigint").alias("n"))


@query("aligned_proba", f"""WITH {v.SCORES}, a AS (SELECT row_id, label, score FROM scores WHERE label IN (1, 3, 5))
  SELECT e.vec_id AS row_id, c.label, round(coalesce(a.score, 0), 6) AS score FROM embeddings e
  CROSS JOIN (SELECT DISTINCT label FROM embeddings) c LEFT JOIN a ON a.row_id = e.vec_id AND a.label = c.label""")
def aligned_proba(spark, d):
    """Scores of a model that knows three classes, aligned to the full label list."""
    s = v.scores(spark, d)
    known = [1, 3, 5]
    arr = s.where(F.col("label").isin(known)).groupBy("row_id").agg(
        *[F.max(F.when(F.col("label") == c, F.col("score"))).alias(f"s{c}") for c in known])
    preds = arr.select("row_id", F.array(*[F.col(f"s{c}") for c in known]).alias("probability"))
    out = mt.align_scores(preds, "row_id", "probability", known, v.vector_labels(spark, d))
    return out.withColumn("score", F.round("score", 6))


@query("batch_score", """WITH m AS (SELECT max(n) * 1.0::DOUBLE / sum(n) AS share FROM (SELECT count(*) AS n FROM documents GROUP BY lang))
  SELECT doc_id AS email_id, lang AS class_label, TRUE AS same, TRUE AS known, round(share, 6) AS majority, TRUE AS beats_majority FROM documents, m""")
def batch_score(spark, d):
    """A stored bundle applied to mail bodies without refitting: it must answer like the model it was saved from."""
    path = scratch_path(spark, "bundle")
    docs = v.texts(spark, d).select("doc_id", "text", F.col("lang").alias("label"))
    fitted = md.refit(docs, v.LANGS, "bow", "logreg", N_TERMS)
    md.save_bundle(fitted, {"labels": v.LANGS}, path)
    loaded, meta = md.load_bundle(spark, path)
    mails = v.emails(spark, d, heavy=True).select("email_id", "class_label", tx.strip_prefix("email_corpus").alias("text"))
    a = materialize(md.score(mails, loaded, meta["labels"], "email_id", extra=["class_label"]), "scored")
    sums = a.agg(F.avg((F.col("pred_label") == F.col("class_label")).cast("int")).alias("hit")).first()
    share = docs.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0] or 0.0
    b = md.score(mails, fitted, v.LANGS, "email_id").select("email_id", F.col("pred_label").alias("p"), F.col("confidence").alias("c"))
    same = (F.col("pred_label") == F.col("p")) & (F.round("confidence", 6) == F.round("c", 6))
    return a.join(b, "email_id").select(
        "email_id", "class_label", same.alias("same"), F.col("pred_label").isin(v.LANGS).alias("known"),
        F.round(F.lit(share), 6).alias("majority"), F.lit((sums["hit"] or 0.0) > share).alias("beats_majority"))
