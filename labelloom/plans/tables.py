"""Registered queries: sources, sinks, schema handling and filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions import text as tx
from labelloom.functions.keys import draw, uniform
from labelloom.operators import metrics as mt
from labelloom.operators import models as md
from labelloom.operators import prepare as pr
from labelloom.operators.split import holdout
from labelloom.plans import views as v
from labelloom.plans.registry import query
from labelloom.session import bounded_values, scratch_path
from labelloom.sources import readers, sinks
from labelloom.sources.buckets import BucketTable

MAIL_COLUMNS = ["email_id", "subject", "email_corpus", "class_label", "secondary_label", "is_multi_intent", "is_spam", "channel"]


@query("read_delimited", f"""WITH {v.EMAILS} SELECT cast(email_id AS VARCHAR) AS email_id, nullif(subject, '') AS subject,
  nullif(email_corpus, '') AS email_corpus, class_label, secondary_label, cast(is_multi_intent AS VARCHAR) AS is_multi_intent,
  cast(is_spam AS VARCHAR) AS is_spam, channel FROM emails""")
def read_delimited(spark, d):
    path = scratch_path(spark, "corpus")
    rows = v.emails(spark, d, spam=True).select(*[F.col(c).cast("string").alias(c) for c in MAIL_COLUMNS])
    sinks.write_corpus(rows, path)
    return readers.read_corpus(spark, path, sep=None, required=("email_corpus", "class_label"))


@query("write_delimited", "SELECT cast(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents")
def write_delimited(spark, d):
    path = scratch_path(spark, "delimited")
    sinks.write_corpus(v.documents(spark, d).select("doc_id", "text", "lang", "source"), path)
    return readers.read_corpus(spark, path, columns=["doc_id", "text", "lang", "source"], missing_marks=())


@query("write_json", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def write_json(spark, d):
    path = scratch_path(spark, "json")
    docs = v.documents(spark, d)
    sinks.write_jsonl(docs, path)
    return spark.read.schema(docs.schema).json(path)


@query("write_parquet", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def write_parquet(spark, d):
    path = scratch_path(spark, "columnar")
    sinks.write_parquet(v.documents(spark, d), path, partition_by=["lang"])
    return spark.read.parquet(path).select("doc_id", "text", "lang", "source", "n_chars")


@query("vector_store_overwrite", """SELECT vec_id AS id, label AS class_label, cast(len(embedding) AS BIGINT) AS n_dims,
  round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings""")
def vector_store_overwrite(spark, d):
    path = scratch_path(spark, "store")
    rows = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("class_label"))
    sinks.store_vectors(rows, path)
    sinks.store_vectors(rows, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return sinks.open_store(spark, path).select(
        "id", "class_label", F.size("embedding").cast("bigint").alias("n_dims"), F.round(total, 4).alias("total"))


@query("vector_store_upsert", f"""WITH stacked AS (SELECT vec_id, label, 0 AS version FROM embeddings
  UNION ALL SELECT vec_id, (label + 1) % 10, 1 FROM embeddings WHERE {v.u("vec_id", "update")} < 0.3
  UNION ALL SELECT vec_id + 1000000, label, 1 FROM embeddings WHERE {v.u("vec_id", "insert")} < 0.1)
  SELECT vec_id, label, version FROM stacked QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY version DESC) = 1""")
def vector_store_upsert(spark, d):
    base = v.table(spark, d, "embeddings").select("vec_id", "label", F.lit(0).alias("version"))
    changed = base.where(uniform("vec_id", "update") < 0.3) \
        .select("vec_id", ((F.col("label") + 1) % 10).alias("label"), F.lit(1).alias("version"))
    added = base.where(uniform("vec_id", "insert") < 0.1) \
        .select((F.col("vec_id") + 1000000).alias("vec_id"), "label", F.lit(1).alias("version"))
    store = BucketTable(spark, scratch_path(spark, "vectors"), base.schema, ["vec_id"])
    store.upsert(base)
    store.upsert(changed.unionByName(added), order="version")
    return store.read()


@query("vector_store_catalog", """SELECT cast(sum(n) AS BIGINT) AS n_rows, count(label) AS n_classes,
  string_agg(label::VARCHAR, ',' ORDER BY label::VARCHAR) AS classes
  FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)""")
def vector_store_catalog(spark, d):
    return sinks.describe_store(v.table(spark, d, "embeddings"), "label")


@query("model_bundle_io", "SELECT doc_id, TRUE AS same FROM documents")
def model_bundle_io(spark, d):
    """Fit, save, load and score again: per document whether both models agree."""
    path = scratch_path(spark, "bundle")
    docs = v.texts(spark, d).select("doc_id", "text", F.col("lang").alias("label"))
    model = md.refit(docs, v.LANGS, "tfidf", "logreg")
    md.save_bundle(model, {"vectorizer": "tfidf", "model": "logreg", "labels": v.LANGS}, path)
    loaded, meta = md.load_bundle(spark, path)
    first = md.score(docs, model, v.LANGS, "doc_id")
    again = md.score(docs, loaded, meta["labels"], "doc_id").select("doc_id", F.col("pred_label").alias("again"))
    both = first.join(again, "doc_id")
    return both.select("doc_id", (F.col("pred_label") == F.col("again")).alias("same"))


SPLIT_SQL = f"""split AS (SELECT doc_id, text, lang AS label, CASE WHEN {v.s_rank("lang", "doc_id")}
  <= round(count(*) OVER (PARTITION BY lang) * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM documents)"""


@query("write_splits", f"""WITH {SPLIT_SQL} SELECT split, doc_id, label, md5(text) AS text_md5, (SELECT count(DISTINCT lang) FROM documents) AS n_labels FROM split""")
def write_splits(spark, d):
    """The rows of both parts as they are read back, with the number of stored labels."""
    path = scratch_path(spark, "splits")
    docs = v.documents(spark, d).select("doc_id", "text", F.col("lang").alias("label"))
    sinks.write_splits(holdout(docs, "label", "doc_id"), path)
    rows, labels = sinks.read_splits(spark, path)
    n = labels.count()
    return rows.select("split", "doc_id", "label", F.md5("text").alias("text_md5"), F.lit(n).cast("bigint").alias("n_labels"))


WIDE_SQL = f"""SELECT 'run' AS run, p.row_id, p.true_label, p.pred_label AS predicted_label, cast(p.true_label = p.pred_label AS INTEGER) AS is_correct,
  round(max(s.score), 6) AS confidence, {", ".join(f"round(max(s.score) FILTER (s.label = {l}), 6) AS score_{l}" for l in v.VECTOR_LABELS)}
  FROM predictions p JOIN scores s USING (row_id) GROUP BY ALL"""


@query("export_predictions", f"WITH {v.PREDICTIONS} {WIDE_SQL}")
def export_predictions(spark, d):
    """The predictions file of a run, read back: correctness, confidence, the audit key and a score per label."""
    long = v.scores(spark, d).groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("class_scores"))
    preds = v.predictions(spark, d).join(long, "row_id").withColumn("confidence", F.array_max(F.map_values("class_scores")))
    wide = sinks.wide_predictions(preds, v.VECTOR_LABELS, pred="pred_label", audit=["row_id"], run="run")
    path = sinks.export_run({"predictions": wide}, scratch_path(spark, "wide"))["predictions"]
    back = spark.read.parquet(path)
    return back.select(*[F.round(c, 6).alias(c) if c == "confidence" or c.startswith("score_") else c for c in back.columns])


@query("export_reports", f"""WITH {v.PREDICTIONS}, labels_ AS (SELECT DISTINCT label FROM embeddings),
  cells AS (SELECT t.label AS a, p.label AS b, count(q.row_id) AS n FROM labels_ t CROSS JOIN labels_ p LEFT JOIN predictions q ON q.true_label = t.label AND q.pred_label = p.label GROUP BY ALL),
  sums AS (SELECT l.label, sum(n) FILTER (a = l.label) AS support, sum(n) FILTER (b = l.label) AS told, sum(n) FILTER (a = l.label AND b = l.label) AS hit FROM cells, labels_ l GROUP BY l.label)
  SELECT 'predictions' AS report, row_id::VARCHAR AS name, pred_label::DOUBLE AS value FROM predictions
  UNION ALL SELECT 'errors', row_id::VARCHAR, pred_label::DOUBLE FROM predictions WHERE true_label <> pred_label
  UNION ALL SELECT 'confusion', a || '-' || b, n::DOUBLE FROM cells
  UNION ALL SELECT 'f1', label::VARCHAR, round(CASE WHEN support + told = 0 THEN 0 ELSE 2 * hit / (support + told) END, 6)::DOUBLE FROM sums
  UNION ALL SELECT 'metrics', 'accuracy', round(sum(cast(true_label = pred_label AS INTEGER)) / count(*), 6)::DOUBLE FROM predictions""")
def export_reports(spark, d):
    """Report tables of a run, made from its one written predictions table; the values as they are read back."""
    labels = v.vector_labels(spark, d)
    path = scratch_path(spark, "reports")
    paths = sinks.export_run({"predictions": v.predictions(spark, d)}, path)
    preds = spark.read.parquet(paths["predictions"])
    conf = mt.confusion(preds, labels)
    paths |= sinks.export_run({
        "metrics": mt.prf_from_confusion(conf, labels), "class_report": mt.report_from_confusion(conf, labels),
        "confusion": conf, "errors": preds.where("true_label <> pred_label"),
    }, path)
    read = {name: spark.read.parquet(p) for name, p in paths.items()}

    def shown(report, name, value, rows=None):
        rows = read[report] if rows is None else rows
        return rows.select(F.lit(report).alias("report"), F.col(name).cast("string").alias("name"), F.round(F.col(value).cast("double"), 6).alias("value"))

    classes = read["class_report"].where(F.col("label").isin([str(l) for l in labels]))
    cells = read["confusion"].withColumn("cell", F.concat_ws("-", F.col("true_label").cast("string"), F.col("pred_label").cast("string")))
    return readers.union_sources([
        shown("predictions", "row_id", "pred_label"), shown("errors", "row_id", "pred_label"), shown("confusion", "cell", "n", cells),
        shown("class_report", "label", "f1", classes).withColumn("report", F.lit("f1")),
        shown("metrics", "name", "accuracy", read["metrics"].withColumn("name", F.lit("accuracy"))),
    ]).select("report", "name", "value")


@query("merge_results", """WITH old AS (SELECT source, lang, round(avg(n_chars), 6) AS score, 0 AS run FROM documents GROUP BY ALL),
  new AS (SELECT source, lang, round(avg(n_chars * quality), 6) AS score, 1 AS run FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
  SELECT * FROM old WHERE (source, lang) NOT IN (SELECT (source, lang) FROM new) UNION ALL SELECT * FROM new""")
def merge_results(spark, d):
    docs = v.documents(spark, d)
    old = docs.groupBy("source", "lang").agg(F.round(F.avg("n_chars"), 6).alias("score")).withColumn("run", F.lit(0))
    seen = docs.join(v.table(spark, d, "labels"), "doc_id")
    new = seen.groupBy("source", "lang").agg(F.round(F.avg(F.col("n_chars") * F.col("quality")), 6).alias("score"))
    return sinks.merge_results(old, new.withColumn("run", F.lit(1)), ["source", "lang"])


@query("normalize_columns", "SELECT doc_id, text, lang, source AS \"source name\" FROM documents")
def normalize_columns(spark, d):
    docs = v.documents(spark, d).select("doc_id", "text", "lang", "source")
    return pr.normalize_columns(docs.toDF(" #Doc_ID", "Text ", "LANG", "Source Name"))


@query("map_known_columns", "SELECT doc_id, text, lang AS label FROM documents")
def map_known_columns(spark, d):
    docs = v.documents(spark, d)
    return pr.map_columns(docs.select("doc_id", F.col("text").alias("message"), F.col("lang").alias("category")))


LABEL_CANDIDATES = ["class_label", "secondary_label", "language", "channel"]


@query("detect_label_column", f"""WITH {v.EMAILS}, c AS (
  SELECT 0 AS pos, 'class_label' AS column_name, count(DISTINCT class_label) AS n_distinct FROM emails
  UNION ALL SELECT 1, 'secondary_label', count(DISTINCT secondary_label) FROM emails
  UNION ALL SELECT 2, 'language', count(DISTINCT language) FROM emails
  UNION ALL SELECT 3, 'channel', count(DISTINCT channel) FROM emails)
  SELECT column_name, n_distinct, abs(n_distinct - 20) AS distance,
  row_number() OVER (ORDER BY abs(n_distinct - 20), pos) = 1 AS chosen FROM c""")
def detect_label_column(spark, d):
    return pr.label_candidates(v.emails(spark, d), LABEL_CANDIDATES, 20)


@query("project_working_set", f"WITH {v.EMAILS} SELECT email_id AS doc_id, email_corpus AS text, class_label AS label FROM emails")
def project_working_set(spark, d):
    return pr.working_set(v.emails(spark, d), "email_id", "email_corpus", "class_label")


@query("compose_text", rf"""WITH {v.EMAILS} SELECT email_id, coalesce(subject, '') || ' ' || coalesce(regexp_replace(email_corpus, '(?i)^body:[{v.BL}]*', ''), '') AS with_subject,
  coalesce(regexp_replace(email_corpus, '(?i)^body:[{v.BL}]*', ''), '') AS body_only FROM emails""")
def compose_text(spark, d):
    rows = v.emails(spark, d).withColumn("body", tx.strip_prefix("email_corpus"))
    return rows.select("email_id", tx.compose_text("subject", "body", True).alias("with_subject"),
                       tx.compose_text("subject", "body", False).alias("body_only"))


@query("drop_missing", f"WITH {v.EMAILS} SELECT email_id, secondary_label FROM emails WHERE secondary_label IS NOT NULL AND email_corpus IS NOT NULL")
def drop_missing(spark, d):
    return pr.drop_missing(v.emails(spark, d), ["email_corpus", "secondary_label"]).select("email_id", "secondary_label")


@query("drop_blank", f"""WITH {v.ANSWERS} SELECT row_id, {v.s_strip("raw_response")} AS raw_response FROM answers WHERE {v.s_strip("raw_response")} <> ''""")
def drop_blank(spark, d):
    return pr.drop_blank(v.answers(spark, d), ["raw_response"]).select("row_id", "raw_response")


@query("filter_known_labels", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'en', 'fr')")
def filter_known_labels(spark, d):
    return pr.known_labels(v.documents(spark, d).select("doc_id", "lang"), ["de", "en", "fr"], "lang")


@query("semi_join_labels", "SELECT doc_id, source FROM documents WHERE lang IN (SELECT lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def semi_join_labels(spark, d):
    docs = v.documents(spark, d)
    seen = docs.join(v.table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("lang")
    return pr.known_labels(docs, seen, "lang").select("doc_id", "source")


@query("anti_join_unknown", "SELECT lang AS label, count(*) AS n FROM documents WHERE lang NOT IN ('de', 'fr') GROUP BY lang ORDER BY lang LIMIT 10")
def anti_join_unknown(spark, d):
    docs = v.documents(spark, d).select(F.col("lang").alias("label"))
    return pr.unknown_labels(docs, ["de", "fr"])


@query("known_class_filter", """SELECT e.vec_id, e.label FROM embeddings e
  WHERE e.label IN (SELECT s.label FROM embeddings s GROUP BY s.label HAVING avg(s.embedding[1]) > 0)""")
def known_class_filter(spark, d):
    e = v.table(spark, d, "embeddings")
    store = e.groupBy("label").agg(F.avg(F.col("embedding")[0]).alias("m")).where("m > 0")
    return pr.known_labels(e.select("vec_id", "label"), store.select("label"))


@query("rejects_report", f"""WITH {v.ANSWERS} SELECT CASE WHEN {v.s_strip("raw_response")} = '' THEN 'blank_text'
  WHEN true_label NOT IN ('de', 'en', 'fr') THEN 'unknown_label' ELSE 'kept' END AS reason, count(*) AS n FROM answers GROUP BY reason""")
def rejects_report(spark, d):
    return pr.rejects(v.answers(spark, d), ["de", "en", "fr"], "raw_response", "true_label")


@query("limit_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def limit_rows(spark, d):
    return pr.head_by_key(v.documents(spark, d).select("doc_id", "lang"), "doc_id", 100)


@query("audit_passthrough", f"""WITH {v.ANSWERS}, {v.EMAILS} SELECT a.row_id, a.true_label, e.channel, e.tone, e.is_spam
  FROM answers a LEFT JOIN emails e ON e.email_id = a.row_id""")
def audit_passthrough(spark, d):
    preds = v.answers(spark, d).select("row_id", "true_label")
    corpus = v.emails(spark, d, spam=True).withColumnRenamed("email_id", "row_id")
    return pr.attach_audit(preds, corpus, "row_id", ["channel", "tone", "is_spam"])


@query("encode_binary_label", f"""SELECT doc_id, CASE WHEN {v.h("doc_id", "spell")} % 4 < 3 THEN toxic END AS label FROM labels
  WHERE {v.h("doc_id", "spell")} % 4 < 3""")
def encode_binary_label(spark, d):
    """Spelled flags in four writings, one of them unknown."""
    rows = v.table(spark, d, "labels")
    kind, yes = draw("doc_id", "spell") % 4, F.col("toxic") == 1
    word = (
        F.when(kind == 0, F.when(yes, " SPAM").otherwise("Ham ")).when(kind == 1, F.when(yes, "yes").otherwise("no"))
        .when(kind == 2, F.col("toxic").cast("string")).otherwise("maybe")
    )
    return pr.binary_label(rows.select("doc_id", word.alias("label")), "label")


@query("encode_sorted_label", """SELECT doc_id, source, cast(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label_index,
  CASE WHEN source = 'src0' THEN 1 ELSE 0 END AS first_source FROM documents""")
def encode_sorted_label(spark, d):
    docs = v.documents(spark, d).select("doc_id", "source")
    out = pr.index_labels(docs, bounded_values(docs, "source"), "source")
    flag = F.when(F.col("source") == "src0", "spam").otherwise("ham")
    two = pr.index_labels(out.withColumn("flag", flag), ["ham", "spam"], "flag", "spam", "first_source")
    return two.drop("flag")


@query("label_indicator", """SELECT d.doc_id, l.lang AS label, cast(d.lang = l.lang AS INTEGER) AS indicator
  FROM documents d CROSS JOIN (SELECT DISTINCT lang FROM documents) l""")
def label_indicator(spark, d):
    docs = v.documents(spark, d)
    return pr.binarize(docs, "doc_id", "lang", bounded_values(docs, "lang"))
