"""Registered queries: Structured Streaming over the event and document files."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions.keys import draw
from labelloom.operators import models as md
from labelloom.plans import views as v
from labelloom.plans.neighbours import rounded
from labelloom.plans.registry import query
from labelloom.session import scratch_path
from labelloom.streaming import scoring as ss
from labelloom.streaming import series as sr
from labelloom.streaming.runs import stream_runs


def stream_of(spark, d, name):
    return sr.table_stream(spark, d, f"{name}.parquet", v.table(spark, d, name).schema)


def sample_stream(spark, d):
    return stream_of(spark, d, "events").select(
        F.col("user_id").alias("series_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("watts"),
        (draw("event_id", "cpu") % 100).alias("cpu_percent"), (draw("event_id", "ram") % 4096).alias("ram_mb"))


HOUR = 3_600_000_000


@query("stream_resample", f"""WITH {v.SAMPLES}, w AS (SELECT *, t // (6 * {HOUR}) * (6 * {HOUR}) AS start FROM samples)
  SELECT series_id, cast(start AS BIGINT) AS window_start, round(avg(watts), 6) AS mean_value, max(watts) AS max_value, count(*) AS n_samples FROM w
  GROUP BY ALL""")
def stream_resample(spark, d):
    """Six-hour windows, all closed by the stream."""
    rows, _ = sr.run_closed(sample_stream(spark, d), lambda samples: sr.stream_windows(samples, "series_id", "ts", "watts", "6 hours", "10 minutes"),
                            "ts", scratch_path(spark, "windows"))
    return rounded(rows.withColumn("window_start", F.unix_micros("window_start")))


PAUSE = 48 * HOUR


@query("stream_run_summary", f"""WITH {v.SAMPLES}, g AS (SELECT *, lag(t) OVER o AS before, CASE WHEN t - lag(t) OVER o < {PAUSE} THEN 0 ELSE 1 END AS fresh FROM samples WINDOW o AS (PARTITION BY series_id ORDER BY t, event_id)),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY t, event_id) AS no FROM g)
  SELECT series_id, min(t) AS run_start, count(*) AS n_samples, round((max(t) - min(t)) / 1000000, 6) AS runtime_seconds,
    round(avg(cpu_percent), 6) AS average_cpu_percent, max(ram_mb)::DOUBLE AS peak_ram_mb, round(avg(watts), 6) AS average_watts,
    round(sum(CASE WHEN fresh = 1 THEN 0 ELSE watts * (t - before) / 1000000 / 3600 END), 6) AS energy_wh, 0::BIGINT AS late_pieces FROM r GROUP BY series_id, no""")
def stream_run_summary(spark, d):
    """Runs of a series without a two-day pause, summed up by the stream's own state and timers; pieces dropped as late beside."""
    rows, late = sr.run_closed(sample_stream(spark, d), lambda samples: stream_runs(samples, "series_id", "ts", "event_id", PAUSE, "10 minutes"),
                               "ts", scratch_path(spark, "runs"))
    return rounded(rows.withColumn("late_pieces", F.lit(late).cast("bigint")))


@query("stream_sessions", f"""WITH {v.SAMPLES}, g AS (SELECT *, CASE WHEN t - lag(t) OVER o < 8 * {HOUR} THEN 0 ELSE 1 END AS fresh FROM samples WINDOW o AS (PARTITION BY series_id ORDER BY t, event_id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY t, event_id) AS no FROM g)
  SELECT series_id, min(t) AS run_start, max(t) AS last_t, count(*) AS n_samples, round(avg(cpu_percent), 6) AS average_cpu_percent, max(ram_mb) AS peak_ram_mb FROM s
  GROUP BY series_id, no""")
def stream_sessions(spark, d):
    """Runs of a series without an eight-hour pause, all ended by the stream."""
    rows, _ = sr.run_closed(sample_stream(spark, d), lambda samples: sr.stream_sessions(samples, "series_id", "ts", "8 hours", "10 minutes"),
                            "ts", scratch_path(spark, "sessions"))
    return rounded(rows.select("series_id", F.unix_micros("run_start").alias("run_start"), F.unix_micros("last_ts").alias("last_t"),
                               "n_samples", "average_cpu_percent", "peak_ram_mb"))


@query("stream_score", "SELECT doc_id, lang AS label, TRUE AS same, TRUE AS known, TRUE AS beats_majority FROM documents")
def stream_score(spark, d):
    """A stored bundle applied to the document stream answers like the same bundle in batch."""
    docs = v.texts(spark, d).select("doc_id", "text", F.col("lang").alias("label"))
    bundle = scratch_path(spark, "bundle")
    md.save_bundle(md.refit(docs, v.LANGS, "bow", "logreg"), {"labels": v.LANGS}, bundle)
    model, meta = md.load_bundle(spark, bundle)
    path = scratch_path(spark, "scored")
    incoming = stream_of(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    scored = md.score(incoming, model, meta["labels"], "doc_id", extra=["label"])
    sr.run_available(scored, path)
    streamed = spark.read.schema(scored.schema).parquet(path)
    hit = streamed.agg(F.avg((F.col("pred_label") == F.col("label")).cast("int"))).first()[0] or 0.0
    share = docs.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0] or 0.0
    batch = md.score(docs, model, meta["labels"], "doc_id").select("doc_id", F.col("pred_label").alias("p"))
    return streamed.join(batch, "doc_id").select(
        "doc_id", "label", (F.col("pred_label") == F.col("p")).alias("same"), F.col("pred_label").isin(v.LANGS).alias("known"),
        F.lit(hit > share).alias("beats_majority"))


@query("stream_cache_dedup", "SELECT DISTINCT concat_ws('|', user_id::VARCHAR, event_type, props) AS key FROM events")
def stream_cache_dedup(spark, d):
    ev = stream_of(spark, d, "events").select(
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    path = scratch_path(spark, "dedup")
    out = ss.stream_dedup(ev, "key", "ts", "60 days").select("key")
    sr.run_available(out, path)
    return spark.read.schema(out.schema).parquet(path)


@query("stream_metrics", f"WITH {v.PREDICTIONS} SELECT true_label, pred_label, count(*) AS n FROM predictions GROUP BY ALL")
def stream_metrics(spark, d):
    """Running confusion of predictions made on the stream; the arg-max is taken inside the row."""
    labels = v.vector_labels(spark, d)
    e = stream_of(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("true_label"))

    def score(label: int):
        pair = F.concat(F.col("row_id").cast("string"), F.lit(f"-{label}"))
        bonus = F.when(F.col("true_label") == label, 700).otherwise(0)
        return F.struct((draw(pair, "score") % 1000 + bonus).alias("s"), F.lit(-label).alias("l"))

    best = F.array_max(F.array(*[score(l) for l in labels]))
    preds = e.select("true_label", (-best["l"]).alias("pred_label"))
    return ss.stream_confusion(preds, scratch_path(spark, "running"))


@query("stream_merge_results", """WITH old AS (SELECT doc_id, 0 AS run, quality AS score FROM labels), new AS (SELECT doc_id, 1 AS run, cast(n_chars % 7 AS INTEGER) AS score FROM documents WHERE lang <> 'en')
  SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new""")
def stream_merge_results(spark, d):
    start = v.table(spark, d, "labels").select("doc_id", F.lit(0).alias("run"), F.col("quality").alias("score"))
    new = stream_of(spark, d, "documents").where("lang <> 'en'").select("doc_id", F.lit(1).alias("run"), (F.col("n_chars") % 7).cast("int").alias("score"))
    return ss.foreach_merge(new, start, ["doc_id"], scratch_path(spark, "merged"))
