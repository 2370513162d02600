"""Registered queries: joins, set operations, splits, resamples and planning."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.functions.keys import epoch_micros, uniform
from labelloom.operators import dedup, planning as pl, split as sp
from labelloom.operators.ordering import BUCKET, order_buckets, running_totals, seeded_rank
from labelloom.plans import views as v
from labelloom.plans.registry import query
from labelloom.plans.texts import PLAN
from labelloom.session import bounded_values, checked_broadcast
from labelloom.sources.readers import union_sources

GRID_TEMPLATE = "Idioma {lang}, fuente {source}, papel {role}."


def _dims(spark, d) -> dict[str, list]:
    docs = v.documents(spark, d)
    return {
        "lang": bounded_values(docs, "lang"), "source": bounded_values(docs, "source"),
        "role": bounded_values(v.table(spark, d, "conversations"), "role"),
    }


GRID_SQL = """WITH l AS (SELECT DISTINCT lang FROM documents), s AS (SELECT DISTINCT source FROM documents), r AS (SELECT DISTINCT role FROM conversations),
  g AS (SELECT row_number() OVER (ORDER BY lang, source, role) - 1 AS combo, lang, source, role FROM l CROSS JOIN s CROSS JOIN r)"""


@query("param_grid", GRID_SQL + """ SELECT *, concat('Idioma ', lang, ', fuente ', source, ', papel ', role, '.') AS prompt,
  md5(concat('Idioma ', lang, ', fuente ', source, ', papel ', role, '.')) AS fp FROM g WHERE combo < 200""")
def param_grid(spark, d):
    grid = pl.param_grid(spark, _dims(spark, d), 200)
    return pl.with_fingerprint(grid, GRID_TEMPLATE, ["lang", "source", "role"])


@query("dedup_fingerprint", GRID_SQL + """, p AS (SELECT combo, concat('Idioma ', lang, ', papel ', role, '.') AS prompt FROM g)
  SELECT min(combo) AS combo, prompt FROM p GROUP BY prompt""")
def dedup_fingerprint(spark, d):
    """The template leaves a dimension out, so whole runs of combinations render alike."""
    grid = pl.param_grid(spark, _dims(spark, d))
    return pl.with_fingerprint(grid, "Idioma {lang}, papel {role}.", ["lang", "role"]).select("combo", "prompt")


MODELS = ["model-a", "model-b", "model-c"]


@query("prompt_model_cross", """SELECT c.conv_id, c.turn, md5(c.text) AS fp, m.model FROM conversations c
  CROSS JOIN (SELECT unnest(['model-a', 'model-b', 'model-c']) AS model) m WHERE c.role = 'user'""")
def prompt_model_cross(spark, d):
    prompts = v.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5("text").alias("fp"))
    return pl.cross_models(prompts, MODELS)


@query("dim_join", """WITH w AS (SELECT source, count(*) AS n_source, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source)
  SELECT doc_id, coalesce(n_source, 0) AS n_source, coalesce(mean_chars, -1) AS mean_chars FROM documents LEFT JOIN w USING (source)""")
def dim_join(spark, d):
    """Fact rows with a small dimension table; misses get defaults."""
    docs = v.documents(spark, d)
    good = docs.join(v.table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    dim = good.groupBy("source").agg(F.count("*").alias("n_source"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    return docs.join(checked_broadcast(dim), "source", "left").select(
        "doc_id", F.coalesce("n_source", F.lit(0)).alias("n_source"), F.coalesce("mean_chars", F.lit(-1.0)).alias("mean_chars"))


@query("cell_range_join", """WITH b AS (SELECT min(epoch_us(ts)) AS t0 FROM events), c AS (SELECT event_type, (epoch_us(ts) - t0) // 86400000000 AS cell, value FROM events, b)
  SELECT event_type, cast(cell AS BIGINT) AS cell, count(*) AS n, round(avg(value), 6) AS mean_value FROM c GROUP BY ALL""")
def cell_range_join(spark, d):
    """Interval membership as an equal key: the cell number is computed, not joined."""
    ev = v.table(spark, d, "events").select("event_type", epoch_micros("ts").alias("t"), "value")
    t0 = ev.agg(F.min("t")).first()[0]
    cell = F.floor((F.col("t") - F.lit(t0)) / 86_400_000_000).cast("bigint")
    return ev.groupBy("event_type", cell.alias("cell")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("cdf_range_join", f"""WITH w AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
  c AS (SELECT source, sum(n) OVER (ORDER BY source) - n AS lo, sum(n) OVER (ORDER BY source) AS hi, sum(n) OVER () AS total FROM w)
  SELECT vec_id, c.source FROM embeddings e JOIN c ON {v.u("vec_id", "pick")} * c.total >= c.lo AND {v.u("vec_id", "pick")} * c.total < c.hi""")
def cdf_range_join(spark, d):
    """Draw a category by the observed source shares; the interval test is a chain of literals.

    Sources are a closed list: more than ``bounded_values`` allows raise.
    """
    docs = v.documents(spark, d)
    closed = bounded_values(docs, "source")
    sizes = docs.where(F.col("source").isin(closed)).groupBy("source").count()
    counts = {r["source"]: float(r["count"]) for r in sizes.collect()}
    at = uniform("vec_id", "pick") * F.lit(sum(counts.values()))
    acc, pick = 0.0, None
    for name in sorted(counts):
        acc += counts[name]
        pick = F.when(at < acc, name) if pick is None else pick.when(at < acc, name)
    return v.table(spark, d, "embeddings").select("vec_id", pick.alias("source"))


@query("cache_left_join", f"""WITH cache AS (SELECT doc_id, 'cached-' || quality AS answer FROM labels)
  SELECT doc_id, lang, answer, TRUE AS cached FROM documents JOIN cache USING (doc_id)
  UNION ALL SELECT doc_id, lang, 'scored-' || lang, FALSE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM cache)""")
def cache_left_join(spark, d):
    docs = v.documents(spark, d).select("doc_id", "lang")
    cache = v.table(spark, d, "labels").select("doc_id", F.concat(F.lit("cached-"), F.col("quality").cast("string")).alias("answer"))
    hits, misses = dedup.split_by_cache(docs, cache, "doc_id")
    fresh = misses.withColumn("answer", F.concat(F.lit("scored-"), "lang"))
    return hits.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))


@query("union_results", """SELECT 'lang' AS dimension, lang AS value, count(*) AS n, -1::BIGINT AS chars FROM documents GROUP BY lang
  UNION ALL SELECT 'source', source, count(*), cast(sum(n_chars) AS BIGINT) FROM documents GROUP BY source""")
def union_results(spark, d):
    docs = v.documents(spark, d)
    a = docs.groupBy(F.col("lang").alias("value")).agg(F.count("*").alias("n")).withColumn("dimension", F.lit("lang"))
    b = docs.groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return union_sources([a, b.withColumn("dimension", F.lit("source"))]).fillna(-1, ["chars"])


@query("dedup_text", "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_text(spark, d):
    return dedup.dedup_first(v.documents(spark, d), "text", "doc_id").select("doc_id", "lang", "source")


@query("dedup_rows", f"SELECT DISTINCT {v.s_clean_latin('text')} AS text, lang AS label FROM documents")
def dedup_rows(spark, d):
    return dedup.dedup_rows(v.texts(spark, d).select(tx.clean_latin("text").alias("text"), F.col("lang").alias("label")))


@query("stratified_holdout", f"""SELECT doc_id, lang, CASE WHEN {v.s_rank("lang", "doc_id")} <= round(count(*) OVER (PARTITION BY lang) * 0.3::DOUBLE)
  THEN 'test' ELSE 'train' END AS split FROM documents""")
def stratified_holdout(spark, d):
    return sp.holdout(v.documents(spark, d).select("doc_id", "lang"), "lang", "doc_id")


KFOLD_SQL = f"""SELECT doc_id, lang, cast(({v.s_rank("lang", "doc_id")} - 1 + dense_rank() OVER (ORDER BY lang) - 1) % 5 AS INTEGER) AS fold FROM documents"""


@query("stratified_kfold", KFOLD_SQL)
def stratified_kfold(spark, d):
    return sp.kfold(v.documents(spark, d).select("doc_id", "lang"), "lang", "doc_id", 5)


ITERATIONS = 100
BOOT_SQL = f"""pos AS (SELECT vec_id AS id, {v.s_rank("", "vec_id")} AS pos FROM embeddings), cnt AS (SELECT count(*) AS n FROM embeddings),
  drawn AS (SELECT it AS iteration, {v.h("concat(it, '-', slot)", "boot42")} % cnt.n + 1 AS pos FROM cnt, range({ITERATIONS}) t(it), range((SELECT n FROM cnt)) s(slot)),
  mult AS (SELECT iteration, pos, count(*) AS multiplicity FROM drawn GROUP BY ALL),
  boot AS (SELECT t.it AS iteration, p.id, coalesce(m.multiplicity, 0) AS multiplicity FROM pos p CROSS JOIN range({ITERATIONS}) t(it)
    LEFT JOIN mult m ON m.iteration = t.it AND m.pos = p.pos)"""


def boot(spark, d):
    return sp.bootstrap(v.table(spark, d, "embeddings"), "vec_id", ITERATIONS)


@query("bootstrap_oob", f"""WITH {BOOT_SQL} SELECT iteration, cast(sum(cast(multiplicity > 0 AS INTEGER)) AS BIGINT) AS n_train,
  cast(sum(cast(multiplicity = 0 AS INTEGER)) AS BIGINT) AS n_oob, cast(sum(multiplicity) AS BIGINT) AS n_draws FROM boot GROUP BY iteration HAVING n_oob >= 2""")
def bootstrap_oob(spark, d):
    return sp.bootstrap_sizes(boot(spark, d))


@query("resample_to_size", f"""WITH r AS (SELECT vec_id, {v.s_rank("", "vec_id")} AS pos FROM embeddings), cnt AS (SELECT count(*) AS n FROM embeddings),
  less AS (SELECT vec_id, 1::BIGINT AS copies FROM r, cnt WHERE pos <= n // 2),
  drawn AS (SELECT {v.h("i", "fill42")} % n + 1 AS pos FROM cnt, range((SELECT 3 * n FROM cnt)) t(i)),
  more AS (SELECT vec_id, count(*) AS copies FROM drawn JOIN r USING (pos) GROUP BY vec_id)
  SELECT 'half' AS target, vec_id, copies FROM less UNION ALL SELECT 'triple', vec_id, copies FROM more""")
def resample_to_size(spark, d):
    rows = v.table(spark, d, "embeddings").select("vec_id")
    n = rows.count()
    half = sp.sample_to(rows, "vec_id", n // 2).withColumn("target", F.lit("half"))
    triple = sp.sample_to(rows, "vec_id", 3 * n).withColumn("target", F.lit("triple"))
    return half.unionByName(triple)


FEW_SQL = f"""WITH {v.EMAILS}, b AS (SELECT email_id, class_label AS label, {v.s_truncate(v.s_normalize_body("email_corpus"), 3000, " [TEXTO TRUNCADO]")} AS body FROM emails),
  r AS (SELECT *, cast(length(body) BETWEEN 50 AND 500 AS INTEGER) AS in_band, md5(concat('42|', email_id)) AS digest FROM b WHERE length(body) > 10),
  k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY in_band DESC, digest) AS rn, max(in_band) OVER (PARTITION BY label) AS best FROM r),
  t AS (SELECT * FROM k WHERE rn <= 3 AND in_band = best),
  few AS (SELECT row_number() OVER (ORDER BY md5(concat(digest, '|shuffle'))) AS example_no, email_id, label,
    {v.s_truncate("body", 400, " [...]")} AS example FROM t)"""


def few(spark, d):
    return sp.few_shot(v.emails(spark, d, heavy=True), v.LANGS, "email_id", "email_corpus", "class_label", per_class=3)


@query("few_shot_sample", FEW_SQL + " SELECT cast(example_no AS INTEGER) AS example_no, email_id, label, example FROM few WHERE example_no <= 12")
def few_shot_sample(spark, d):
    return few(spark, d)


@query("prefer_length_band", FEW_SQL + """ SELECT string_agg(concat('Ejemplo ', example_no, ':', chr(10), 'Texto del correo:', chr(10), example, chr(10), chr(10),
  'Etiqueta correcta:', chr(10), label), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY example_no) AS examples FROM few""")
def prefer_length_band(spark, d):
    """The numbered block the band-first examples make."""
    return sp.few_shot_block(few(spark, d))


@query("weighted_assign", f"WITH {PLAN} SELECT email_id, class_label, email_length, noise_level FROM plan")
def weighted_assign(spark, d):
    return pl.corpus_plan(v.documents(spark, d), "doc_id").select("email_id", "class_label", "email_length", "noise_level")


@query("secondary_assign", f"WITH {PLAN} SELECT email_id, class_label, secondary_label FROM plan")
def secondary_assign(spark, d):
    return pl.corpus_plan(v.documents(spark, d), "doc_id").select("email_id", "class_label", "secondary_label")


@query("plan_params", f"WITH {PLAN} SELECT email_id, temperature, top_p, top_k, seed FROM plan")
def plan_params(spark, d):
    return pl.corpus_plan(v.documents(spark, d), "doc_id").select("email_id", "temperature", "top_p", "top_k", "seed")


@query("plan_flags", f"WITH {PLAN} SELECT email_id, is_multi_intent, is_ambiguous, is_spam, language, tone, sender_profile, channel FROM plan")
def plan_flags(spark, d):
    return pl.corpus_plan(v.documents(spark, d), "doc_id").select(
        "email_id", "is_multi_intent", "is_ambiguous", "is_spam", "language", "tone", "sender_profile", "channel")


@query("assign_round_robin", f"""SELECT doc_id, list_extract(['model-a', 'model-b', 'model-c'], (row_number() OVER (ORDER BY doc_id) - 1) % 3 + 1) AS model_assigned,
  CASE WHEN {v.u("doc_id", "model")} < 0.5::DOUBLE THEN 'model-a' WHEN {v.u("doc_id", "model")} < 0.8::DOUBLE THEN 'model-b' ELSE 'model-c' END AS weighted_model,
  list_extract(['model-a', 'model-b', 'model-c'], {v.h("doc_id", "model")} % 3 + 1) AS random_model FROM documents""")
def assign_round_robin(spark, d):
    docs = v.documents(spark, d).select("doc_id")
    docs = pl.assign_models(docs, "doc_id", MODELS, "weighted", [0.5, 0.3, 0.2]).withColumnRenamed("model_assigned", "weighted_model")
    docs = pl.assign_models(docs, "doc_id", MODELS, "random").withColumnRenamed("model_assigned", "random_model")
    return pl.assign_models(docs, "doc_id", MODELS)


@query("rank_in_group", f"SELECT doc_id, source, {v.s_rank('source', 'doc_id', 7)} AS rank, count(*) OVER (PARTITION BY source) AS rank_total FROM documents")
def rank_in_group(spark, d):
    return seeded_rank(v.documents(spark, d).select("doc_id", "source"), ["source"], "doc_id", 7)


@query("running_count", """SELECT doc_id, lang, row_number() OVER w AS n_so_far, cast(sum(n_chars) OVER w AS BIGINT) AS chars_so_far FROM documents
  WINDOW w AS (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""")
def running_count(spark, d):
    docs = order_buckets(v.documents(spark, d).select("doc_id", "lang", "n_chars"), "doc_id")
    out = running_totals(docs, ["lang"], [F.col("doc_id")], {"n_so_far": F.lit(1).cast("bigint"), "chars_so_far": F.col("n_chars")})
    return out.drop(BUCKET, "n_chars")


@query("top_per_group", """SELECT source, doc_id, n_chars, cast(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS place
  FROM documents QUALIFY place <= 3""")
def top_per_group(spark, d):
    order = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return v.documents(spark, d).select("source", "doc_id", "n_chars", F.row_number().over(order).alias("place")).where("place <= 3")
