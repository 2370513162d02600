"""Registered queries: exact vector nearest neighbours and what is built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import knn as nn
from labelloom.operators import metrics as mt
from labelloom.operators.split import holdout, kfold
from labelloom.plans import views as v
from labelloom.plans.registry import query
from labelloom.plans.sampling import BOOT_SQL, boot
from labelloom.session import materialize

K = 5


def s_prf(preds: str, labels: str, by: str = "", extra: str = "") -> str:
    """CTEs ending in ``prf``: accuracy and macro/weighted metrics per ``by`` over a label list."""
    b = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""lab AS ({labels}),
  cls AS (SELECT {b}l.label, cast(sum(cast(true_label = l.label AS INTEGER)) AS BIGINT) AS support, cast(sum(cast(pred_label = l.label AS INTEGER)) AS BIGINT) AS predicted,
    cast(sum(cast(true_label = l.label AND pred_label = l.label AS INTEGER)) AS BIGINT) AS tp FROM {preds} CROSS JOIN lab l GROUP BY {b}l.label),
  pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM cls),
  f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr),
  prf AS (SELECT {b}cast(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy,
    round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
    round(sum(precision * support) / sum(support), 6) AS precision_weighted, round(sum(recall * support) / sum(support), 6) AS recall_weighted,
    round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM f {group})"""


VEC_LABELS = "SELECT DISTINCT label FROM embeddings"
DIST = "round(list_cosine_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"


def rounded(df, places=6):
    """Round every double column."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


PAIRS = f"""pairs AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, b.label AS payload, {DIST} AS distance
  FROM embeddings q, embeddings b WHERE q.vec_id <> b.vec_id),
  near AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY distance, base_id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= {K})"""
VOTE = """vote AS (SELECT query_id, payload AS pred_label, count(*) AS votes FROM near GROUP BY query_id, payload
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank)) = 1)"""


def near(spark, d, k=K):
    e = v.table(spark, d, "embeddings")
    return nn.knn(e, e, k, payload="label", exclude="id")


@query("knn_topk", f"WITH {PAIRS} SELECT query_id, rank, base_id, round(distance, 6) AS distance FROM near")
def knn_topk(spark, d):
    return rounded(near(spark, d).drop("payload"))


@query("knn_join", f"""WITH sp AS (SELECT *, {v.s_rank("label", "vec_id")} <= round(count(*) OVER (PARTITION BY label) * 0.3::DOUBLE) AS test FROM embeddings),
  p AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, {DIST} AS distance FROM sp q, sp b WHERE q.test AND NOT b.test)
  SELECT query_id, base_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY distance, base_id) AS INTEGER) AS rank, round(distance, 6) AS distance
  FROM p QUALIFY rank <= 3""")
def knn_join(spark, d):
    """Two different sides, searched with pivot cells so that far cells are skipped."""
    e = holdout(v.table(spark, d, "embeddings"), "label", "vec_id")
    out = nn.knn(e.where("split = 'test'"), e.where("split = 'train'"), 3, n_pivots=8, block_rows=64, query_rows=64)
    return rounded(out.drop("payload"))


@query("knn_classify", f"WITH {PAIRS}, {VOTE} SELECT query_id, pred_label, votes FROM vote")
def knn_classify(spark, d):
    return nn.knn_vote(near(spark, d))


@query("knn_proba", f"""WITH {PAIRS}, lab AS ({VEC_LABELS}), q AS (SELECT DISTINCT query_id FROM near),
  n AS (SELECT query_id, payload AS label, count(*) AS votes FROM near GROUP BY ALL)
  SELECT query_id, label, round((coalesce(votes, 0) + 1) / ({K} + (SELECT count(*) FROM lab))::DOUBLE, 6) AS score FROM q CROSS JOIN lab LEFT JOIN n USING (query_id, label)""")
def knn_proba(spark, d):
    return rounded(nn.knn_scores(near(spark, d), v.vector_labels(spark, d)))


HOLD = f"""sp AS (SELECT *, {v.s_rank("label", "vec_id")} <= round(count(*) OVER (PARTITION BY label) * 0.3::DOUBLE) AS test FROM embeddings),
  p AS (SELECT q.vec_id AS query_id, q.label AS true_label, b.vec_id AS base_id, b.label AS payload, {DIST} AS distance FROM sp q, sp b WHERE q.test AND NOT b.test),
  near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, base_id) AS rank FROM p QUALIFY rank <= {K}),
  preds AS (SELECT query_id, true_label, payload AS pred_label FROM near GROUP BY query_id, true_label, payload
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank)) = 1)"""


def holdout_predictions(spark, d):
    e = materialize(holdout(v.table(spark, d, "embeddings"), "label", "vec_id"), "vector-split")
    test = e.where("split = 'test'")
    votes = nn.knn_vote(nn.knn(test, e.where("split = 'train'"), K, payload="label"))
    truth = test.select(F.col("vec_id").alias("query_id"), F.col("label").alias("true_label"))
    return materialize(votes.join(truth, "query_id"), "knn-predictions")


@query("knn_holdout_eval", f"WITH {HOLD}, {s_prf('preds', VEC_LABELS)} SELECT * FROM prf")
def knn_holdout_eval(spark, d):
    return rounded(mt.prf(holdout_predictions(spark, d), v.vector_labels(spark, d)))


FLAG = f"""WITH {HOLD}, {s_prf('preds', VEC_LABELS)}
  SELECT label::VARCHAR AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
  UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, n FROM prf UNION ALL SELECT 'macro avg', precision_macro, recall_macro, f1_macro, n FROM prf
  UNION ALL SELECT 'weighted avg', precision_weighted, recall_weighted, f1_weighted, n FROM prf"""


@query("knn_holdout_report", FLAG)
def knn_holdout_report(spark, d):
    """Flagship: hold out, search, vote, report per class."""
    return rounded(mt.class_report(holdout_predictions(spark, d), v.vector_labels(spark, d)))


METRICS = ", ".join(mt.METRICS)


@query("knn_cv_eval", f"""WITH fl AS (SELECT *, ({v.s_rank("label", "vec_id")} - 1 + dense_rank() OVER (ORDER BY label) - 1) % 5 AS fold FROM embeddings),
  p AS (SELECT q.vec_id AS query_id, q.fold, q.label AS true_label, b.vec_id AS base_id, b.label AS payload, {DIST} AS distance FROM fl q, fl b WHERE q.fold <> b.fold),
  near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, base_id) AS rank FROM p QUALIFY rank <= {K}),
  preds AS (SELECT query_id, fold, true_label, payload AS pred_label FROM near GROUP BY query_id, fold, true_label, payload
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank)) = 1),
  {s_prf('preds', VEC_LABELS, 'fold').replace('round(', '(').replace(', 6)', ')')},
  long AS (UNPIVOT (SELECT {METRICS} FROM prf) ON {METRICS} INTO NAME metric VALUE value)
  SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n_folds FROM long GROUP BY metric""")
def knn_cv_eval(spark, d):
    """One self-join serves all folds: neighbours of the query's own fold are left out."""
    e = materialize(kfold(v.table(spark, d, "embeddings"), "label", "vec_id", 5), "vector-folds")
    votes = nn.knn_vote(nn.knn(e, e, K, payload="label", qgroup="fold", bgroup="fold", exclude="group"))
    truth = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("true_label"), "fold")
    preds = materialize(votes.join(truth, "query_id"), "cv-predictions")
    return rounded(mt.fold_summary(mt.fold_metrics(preds, v.vector_labels(spark, d))))


BOOT_PREDS = f"""{BOOT_SQL}, allpairs AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, b.label AS payload, {DIST} AS distance FROM embeddings q, embeddings b),
  cand AS (SELECT o.iteration, a.query_id, a.base_id, a.payload, a.distance, i.multiplicity,
    coalesce(sum(i.multiplicity) OVER (PARTITION BY o.iteration, a.query_id ORDER BY a.distance, a.base_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    row_number() OVER (PARTITION BY o.iteration, a.query_id ORDER BY a.distance, a.base_id) AS rank
    FROM allpairs a JOIN boot o ON o.id = a.query_id AND o.multiplicity = 0 JOIN boot i ON i.id = a.base_id AND i.iteration = o.iteration AND i.multiplicity > 0),
  bv AS (SELECT iteration, query_id, payload AS pred_label FROM cand WHERE before < {K} GROUP BY iteration, query_id, payload
    QUALIFY row_number() OVER (PARTITION BY iteration, query_id ORDER BY sum(least(multiplicity, {K} - before)) DESC, min(rank)) = 1),
  bpreds AS (SELECT b.iteration, b.pred_label, e.label AS true_label FROM bv b JOIN embeddings e ON e.vec_id = b.query_id)"""


def bootstrap_metrics(spark, d):
    e = v.table(spark, d, "embeddings")
    return mt.prf_from_confusion(nn.knn_bootstrap(e, boot(spark, d), K, "label"), v.vector_labels(spark, d), ["iteration"])


@query("knn_bootstrap_eval", f"WITH {BOOT_PREDS}, {s_prf('bpreds', VEC_LABELS, 'iteration')} SELECT * FROM prf")
def knn_bootstrap_eval(spark, d):
    return rounded(bootstrap_metrics(spark, d))


@query("semantic_search", """WITH dims AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
  c AS (SELECT label, i, avg(x) AS x FROM dims GROUP BY ALL), q AS (SELECT label, list(x ORDER BY i) AS embedding FROM c GROUP BY label),
  p AS (SELECT q.label AS query_id, b.vec_id AS base_id, b.label, round(list_cosine_distance(q.embedding, b.embedding::DOUBLE[]), 9) AS distance FROM q, embeddings b)
  SELECT query_id, base_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY distance, base_id) AS INTEGER) AS rank, round(distance, 6) AS distance, label FROM p QUALIFY rank <= 10""")
def semantic_search(spark, d):
    """Ten stored vectors nearest to the centre of each label, with their metadata."""
    e = v.table(spark, d, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One row per label and dimension is left: a vector of fixed length each.
    centre = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    queries = centre.select(F.col("label").cast("bigint").alias("vec_id"), "embedding")
    out = nn.search(e, queries, 10, ["label"])
    return rounded(out.withColumn("query_id", F.col("query_id").cast("int")))
