"""Registered queries: classification metrics and corpus profile."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.functions.keys import draw
from labelloom.operators import metrics as mt
from labelloom.operators import profile as pf
from labelloom.operators.split import kfold
from labelloom.plans import views as v
from labelloom.plans.neighbours import BOOT_PREDS, METRICS, VEC_LABELS, bootstrap_metrics, rounded, s_prf
from labelloom.plans.registry import query
from labelloom.session import bounded_values, materialize
from labelloom.sources.readers import union_sources

P = v.PREDICTIONS
ZERO_FILLED = f"""{P}, lab AS ({VEC_LABELS}), conf AS (SELECT a.label AS true_label, b.label AS pred_label,
  (SELECT count(*) FROM predictions p WHERE p.true_label = a.label AND p.pred_label = b.label) AS n FROM lab a CROSS JOIN lab b)"""


def preds_and_labels(spark, d):
    return v.predictions(spark, d), v.vector_labels(spark, d)


@query("confusion_long", f"WITH {ZERO_FILLED} SELECT * FROM conf")
def confusion_long(spark, d):
    return mt.confusion(*preds_and_labels(spark, d))


@query("confusion_matrix", f"WITH {ZERO_FILLED} SELECT true_label, " + ", ".join(
    f"cast(sum(CASE WHEN pred_label = {i} THEN n ELSE 0 END) AS BIGINT) AS pred_{i}" for i in v.VECTOR_LABELS) + " FROM conf GROUP BY true_label")
def confusion_matrix(spark, d):
    return mt.confusion_matrix(*preds_and_labels(spark, d))


@query("confusion_normalized", f"""WITH {ZERO_FILLED} SELECT true_label, pred_label, n,
  round(CASE WHEN sum(n) OVER (PARTITION BY true_label) > 0 THEN n / sum(n) OVER (PARTITION BY true_label) ELSE 0 END, 6) AS share FROM conf""")
def confusion_normalized(spark, d):
    return rounded(mt.confusion_norm(*preds_and_labels(spark, d)))


@query("accuracy", f"WITH {P} SELECT count(*) AS n, round(avg(cast(true_label = pred_label AS INTEGER)), 6) AS accuracy FROM predictions")
def accuracy(spark, d):
    return rounded(mt.accuracy(v.predictions(spark, d)))


@query("class_report", f"""WITH {P}, {s_prf('predictions', VEC_LABELS)}
  SELECT label::VARCHAR AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
  UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, n FROM prf UNION ALL SELECT 'macro avg', precision_macro, recall_macro, f1_macro, n FROM prf
  UNION ALL SELECT 'weighted avg', precision_weighted, recall_weighted, f1_weighted, n FROM prf""")
def class_report(spark, d):
    return rounded(mt.class_report(*preds_and_labels(spark, d)))


@query("macro_weighted_prf", f"WITH {P}, {s_prf('predictions', VEC_LABELS)} SELECT * FROM prf")
def macro_weighted_prf(spark, d):
    return rounded(mt.prf(*preds_and_labels(spark, d)))


RUNS = f"{P}, runs AS (SELECT *, 'run-' || ({v.h('row_id', 'run')} % 3) AS run FROM predictions)"


def runs(spark, d):
    """Predictions of three runs."""
    run = F.concat(F.lit("run-"), (draw("row_id", "run") % 3).cast("string"))
    return v.predictions(spark, d).withColumn("run", run)


@query("per_class_f1", f"WITH {RUNS}, {s_prf('runs', VEC_LABELS, 'run')} SELECT run, label, round(f1, 6) AS f1, support FROM f")
def per_class_f1(spark, d):
    return rounded(mt.per_class_f1(runs(spark, d), v.vector_labels(spark, d), "run"))


def steps_sql(src: str, by: str, pos: str, score: str) -> str:
    return f"""st0 AS (SELECT {by}, {score} AS score, cast(sum(cast({pos} AS INTEGER)) AS BIGINT) AS pos, cast(sum(cast(NOT ({pos}) AS INTEGER)) AS BIGINT) AS neg FROM {src} GROUP BY ALL),
  st AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {by}) AS p, sum(neg) OVER (PARTITION BY {by}) AS n FROM st0
    WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  area AS (SELECT {by}, sum(pos * (n - fp + neg / 2)) / (max(p) * max(n)) AS auc, sum(pos * tp / (tp + fp)) / max(p) AS ap, max(p) AS support FROM st GROUP BY {by})"""


OVR = v.SCORES + ", " + steps_sql("scores", "label", "true_label = label", "score")


@query("roc_auc_ovr", f"WITH {OVR} SELECT round(avg(auc), 6) AS roc_auc_macro, round(sum(auc * support) / sum(support), 6) AS roc_auc_weighted FROM area")
def roc_auc_ovr(spark, d):
    return rounded(mt.roc_auc(v.scores(spark, d), v.vector_labels(spark, d)))


@query("roc_points", f"""WITH {OVR}, top AS (SELECT label FROM area ORDER BY support DESC, label LIMIT 4)
  SELECT label, score AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM st WHERE label IN (SELECT label FROM top)""")
def roc_points(spark, d):
    return rounded(mt.roc_points(v.scores(spark, d), 4))


BIN = v.BINARY + ", b1 AS (SELECT *, 1 AS one FROM bin), " + steps_sql("b1", "one", "y = 1", "p")


def binary_steps(spark, d):
    return v.binary(spark, d).withColumn("one", F.lit(1))


@query("pr_points", f"WITH {BIN} SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM st")
def pr_points(spark, d):
    return rounded(mt.pr_points(binary_steps(spark, d), ["one"], F.col("y") == 1, "p").drop("one"))


@query("average_precision", f"WITH {OVR} SELECT label, round(ap, 6) AS average_precision FROM area")
def average_precision(spark, d):
    return rounded(mt.avg_precision(v.scores(spark, d)))


@query("log_loss", f"""WITH {v.SCORES}, r AS (SELECT row_id, max(CASE WHEN label = true_label THEN score END) / sum(score) AS p FROM scores GROUP BY row_id)
  SELECT round(avg(-ln(least(1 - {mt.EPS!r}::DOUBLE, greatest({mt.EPS!r}::DOUBLE, p)))), 6) AS log_loss FROM r""")
def log_loss(spark, d):
    return rounded(mt.log_loss(v.scores(spark, d)))


@query("binary_metrics", f"""WITH {BIN}, c AS (SELECT count(*) AS n, sum(cast(y = 1 AND p >= 0.5::DOUBLE AS INTEGER)) AS tp, sum(cast(y = 0 AND p >= 0.5::DOUBLE AS INTEGER)) AS fp,
  sum(cast(y = 1 AND p < 0.5::DOUBLE AS INTEGER)) AS fn, avg(-ln(least(1 - {mt.EPS!r}::DOUBLE, greatest({mt.EPS!r}::DOUBLE, CASE WHEN y = 1 THEN p ELSE 1 - p END)))) AS ll FROM bin)
  SELECT n, round((n - fp - fn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision, round(ll, 6) AS log_loss FROM c, area""")
def binary_metrics(spark, d):
    return rounded(mt.binary_metrics(v.binary(spark, d), "y", "p"))


FOLDS = f"""{P}, fl AS (SELECT *, cast(({v.s_rank("true_label", "row_id")} - 1 + dense_rank() OVER (ORDER BY true_label) - 1) % 5 AS INTEGER) AS fold FROM predictions),
  allf AS (SELECT fold, true_label, pred_label FROM fl UNION ALL SELECT -1, true_label, pred_label FROM fl)"""


def folded(spark, d):
    return kfold(materialize(v.predictions(spark, d), "predictions"), "true_label", "row_id", 5)


@query("fold_metrics", f"WITH {FOLDS}, {s_prf('allf', VEC_LABELS, 'fold')} SELECT * FROM prf")
def fold_metrics(spark, d):
    return rounded(mt.fold_metrics(folded(spark, d), v.vector_labels(spark, d)))


LONG = f"long AS (UNPIVOT (SELECT {METRICS} FROM prf) ON {METRICS} INTO NAME metric VALUE value)"


def unrounded(sql: str) -> str:
    return sql.replace("round(", "(").replace(", 6)", ")")


@query("fold_summary", f"""WITH {FOLDS}, {unrounded(s_prf('fl', VEC_LABELS, 'fold'))}, {LONG}
  SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n_folds FROM long GROUP BY metric""")
def fold_summary(spark, d):
    return rounded(mt.fold_summary(mt.fold_metrics(folded(spark, d), v.vector_labels(spark, d))))


BOOT_LONG = f"{BOOT_PREDS}, {unrounded(s_prf('bpreds', VEC_LABELS, 'iteration'))}, {LONG}"


@query("bootstrap_summary", f"""WITH {BOOT_LONG} SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
  round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.975), 6) AS ci_high FROM long GROUP BY metric""")
def bootstrap_summary(spark, d):
    return rounded(mt.boot_summary(materialize(bootstrap_metrics(spark, d), "boot-metrics")))


@query("metric_distribution", f"""WITH {FOLDS}, {unrounded(s_prf('fl', VEC_LABELS, 'fold'))}, {LONG}
  SELECT metric, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median,
  round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high FROM long GROUP BY metric""")
def metric_distribution(spark, d):
    fm = mt.fold_metrics(folded(spark, d), v.vector_labels(spark, d)).where("fold >= 0")
    return rounded(mt.metric_box(fm, "fold"))


@query("error_rows", f"""WITH {RUNS}, e AS (SELECT *, {v.h("row_id", "unparsed")} % 20 = 0 AS parse_error FROM runs)
  SELECT run, count(*) AS n, cast(sum(cast(true_label <> pred_label AS INTEGER)) AS BIGINT) AS n_wrong, cast(sum(cast(parse_error AS INTEGER)) AS BIGINT) AS n_parse_error,
  round(avg(cast(true_label <> pred_label AS INTEGER)), 6) AS error_rate FROM e GROUP BY run""")
def error_rows(spark, d):
    rows = runs(spark, d).withColumn("parse_error", draw("row_id", "unparsed") % 20 == 0)
    return rounded(mt.errors(rows, ["run"]))


@query("top_confusions", f"WITH {P} SELECT true_label, pred_label, count(*) AS n FROM predictions WHERE true_label <> pred_label GROUP BY ALL ORDER BY n DESC, true_label, pred_label LIMIT 10")
def top_confusions(spark, d):
    return mt.top_confusions(v.predictions(spark, d))


@query("confidence_histogram", f"""WITH {P}, c AS (SELECT true_label = pred_label AS correct, confidence FROM predictions),
  g AS (SELECT correct, min(confidence) AS lo, (max(confidence) - min(confidence)) / 40 AS width, count(*) AS total FROM c GROUP BY correct),
  b AS (SELECT c.correct, CASE WHEN width > 0 THEN least(39, floor((confidence - lo) / width)) ELSE 0 END::INTEGER AS bin, lo, width, total FROM c JOIN g ON c.correct = g.correct)
  SELECT correct, bin, round(lo + bin * width, 8) AS "left", count(*) AS n, round(count(*) / (total * width), 6) AS density FROM b GROUP BY correct, bin, lo, width, total""")
def confidence_histogram(spark, d):
    rows = v.predictions(spark, d).select((F.col("true_label") == F.col("pred_label")).alias("correct"), "confidence")
    out = mt.histogram(rows, "confidence", "correct")
    return out.select("correct", "bin", F.round("left", 8).alias("left"), "n", F.round("density", 6).alias("density"))


@query("run_comparison", f"""WITH {RUNS}, {s_prf('runs', VEC_LABELS, 'run')}, t AS (SELECT run AS technique, accuracy, f1_macro FROM prf
  UNION ALL SELECT 'all', round(avg(cast(true_label = pred_label AS INTEGER)), 6), NULL FROM predictions)
  SELECT technique, accuracy, coalesce(f1_macro, -1) AS f1_macro, cast(row_number() OVER (ORDER BY accuracy DESC, technique) AS INTEGER) AS place FROM t""")
def run_comparison(spark, d):
    """Runs and the pooled run stacked into one table, best first."""
    each = mt.prf(runs(spark, d), v.vector_labels(spark, d), ["run"]).select(F.col("run").alias("technique"), "accuracy", "f1_macro")
    pooled = mt.accuracy(v.predictions(spark, d)).select(F.lit("all").alias("technique"), "accuracy")
    table = rounded(union_sources([each, pooled])).fillna(-1.0, ["f1_macro"])
    # One row per run: the place is taken over a handful of rows.
    return table.withColumn("place", F.row_number().over(W.orderBy(F.desc("accuracy"), "technique")))


TIMES = """times AS (SELECT event_type AS run, user_id % 10 AS repeat, CASE WHEN event_id % 2 = 0 THEN 'encode' ELSE 'query' END AS stage,
  round(sum(value), 6) AS seconds, 1000::BIGINT AS n FROM events GROUP BY ALL)"""


@query("latency_summary", f"""WITH {TIMES}, tot AS (SELECT run, repeat, 'total' AS stage, sum(seconds) AS seconds, max(n) AS n FROM times GROUP BY run, repeat),
  a AS (SELECT run, repeat, stage, seconds, n FROM tot UNION ALL SELECT run, repeat, stage, seconds, n FROM times)
  SELECT run, stage, count(*) AS n_repeats, round(avg(seconds), 6) AS total_s, round(max(n) / avg(seconds), 6) AS rows_per_s, round(avg(seconds) / max(n) * 1000, 6) AS ms_per_row,
  round(quantile_cont(seconds / n * 1000, 0.5), 6) AS p50_ms, round(quantile_cont(seconds / n * 1000, 0.95), 6) AS p95_ms, round(quantile_cont(seconds / n * 1000, 0.99), 6) AS p99_ms FROM a GROUP BY run, stage""")
def latency_summary(spark, d):
    ev = v.table(spark, d, "events")
    stage = F.when(F.col("event_id") % 2 == 0, "encode").otherwise("query")
    times = ev.groupBy(F.col("event_type").alias("run"), (F.col("user_id") % 10).alias("repeat"), stage.alias("stage")) \
        .agg(F.round(F.sum("value"), 6).alias("seconds")).withColumn("n", F.lit(1000).cast("bigint"))
    return rounded(mt.latency(times))


@query("value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def value_counts(spark, d):
    return pf.value_counts(v.documents(spark, d), "lang")


@query("crosstab", f"WITH {v.EMAILS} SELECT noise_level, " + ", ".join(
    f"cast(sum(cast(tone = {i} AS INTEGER)) AS BIGINT) AS tone_{i}" for i in range(8)) + " FROM emails GROUP BY noise_level")
def crosstab(spark, d):
    mails = v.emails(spark, d)
    return pf.crosstab(mails, "noise_level", "tone", bounded_values(mails, "tone"), "tone_")


@query("grouped_counts_filled", """SELECT l.lang, s.source, (SELECT count(*) FROM documents d JOIN labels t USING (doc_id) WHERE d.lang = l.lang AND d.source = s.source AND t.toxic = 1) AS n
  FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s""")
def grouped_counts_filled(spark, d):
    docs = v.documents(spark, d)
    toxic = docs.join(v.table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return pf.counts_filled(toxic, "lang", "source", bounded_values(docs, "lang"), bounded_values(docs, "source"))


FLAGS = ["is_multi_intent", "is_ambiguous", "is_spam"]


@query("flag_rates", f"WITH {v.EMAILS} " + " UNION ALL ".join(
    f"SELECT '{f}' AS flag, cast(sum(cast({f} AS INTEGER)) AS BIGINT) AS n_true, round(avg(cast({f} AS INTEGER)), 6) AS share FROM emails" for f in FLAGS))
def flag_rates(spark, d):
    return rounded(pf.flag_rates(v.emails(spark, d, spam=True), FLAGS))


@query("corpus_summary", """SELECT count(*) AS n_rows, count(DISTINCT source) AS n_classes, count(DISTINCT lang) AS n_languages,
  (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 1) AS top_class,
  (SELECT count(*) FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 1) AS top_n FROM documents""")
def corpus_summary(spark, d):
    return pf.summary(v.documents(spark, d), "source", "lang")


@query("length_profile", "SELECT lang, count(*) AS n, cast(min(length(text)) AS INTEGER) AS min_len, median(length(text)) AS median_len, cast(max(length(text)) AS INTEGER) AS max_len FROM documents GROUP BY lang")
def length_profile(spark, d):
    return pf.length_profile(v.documents(spark, d), "text", ["lang"])


@query("rare_classes", "SELECT lang || '-' || source AS label, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) < 5")
def rare_classes(spark, d):
    rows = v.documents(spark, d).select(F.concat_ws("-", "lang", "source").alias("label"))
    return pf.rare(rows, "label", 5)


RECORDS = f"""rec AS (SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS response, 'model-' || ({v.h("a.conv_id", "m")} % 3) AS model, b.role AS kind,
  b.text IS NULL OR length(b.text) < 40 AS has_error FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def records(spark, d):
    """A prompt turn with the turn that answers it."""
    c = v.table(spark, d, "conversations")
    model = F.concat(F.lit("model-"), (draw("conv_id", "m") % 3).cast("string"))
    prompts = c.select("conv_id", "turn", F.col("text").alias("prompt"), model.alias("model"), F.col("text").alias("context"))
    replies = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"), F.col("role").alias("kind"),
                       (F.col("text").isNull() | (F.length("text") < 40)).alias("has_error"))
    return prompts, replies


@query("store_stats", f"""WITH {RECORDS} SELECT count(*) AS total_records, cast(sum(cast(has_error AS INTEGER)) AS BIGINT) AS errors,
  round((count(*) - sum(cast(has_error AS INTEGER))) / count(*) * 100, 6) AS success_rate, count(DISTINCT model) AS models_used, count(DISTINCT kind) AS types FROM rec""")
def store_stats(spark, d):
    prompts, replies = records(spark, d)
    return rounded(pf.store_stats(prompts.join(replies, ["conv_id", "turn"]), "has_error", "model", "kind"))


@query("response_record", f"WITH {RECORDS} SELECT conv_id, turn, model, kind, has_error, md5(response) AS response, substr(prompt, 1, 200) AS context FROM rec")
def response_record(spark, d):
    prompts, replies = records(spark, d)
    key = F.struct("conv_id", "turn").alias("key")
    out = pf.response_records(prompts.select(key, "model", "context"), replies.select(key, "response", "kind", "has_error"), "key", "context")
    return out.select("key.conv_id", "key.turn", "model", "kind", "has_error", F.md5("response").alias("response"), "context")
