"""Registered queries: prompts scored by a pluggable text-to-text client."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions import text as tx
from labelloom.functions.answers import fixed
from labelloom.functions.render import FEW_SHOT, ZERO_SHOT
from labelloom.operators import scoring as sc
from labelloom.operators.split import few_shot, few_shot_block, holdout
from labelloom.plans import views as v
from labelloom.plans.registry import query
from labelloom.plans.texts import LABEL_LINES, ZERO
from labelloom.session import materialize, scratch_path
from labelloom.sources import sinks
from labelloom.sources.buckets import BucketTable

CHUNK = 500  # rows whose answers the test client commits together
LIMIT = 600  # characters the small test client accepts


def digest_scorer(labels: list[str], limit: int | None = None):
    """Client factory for checks: the answer depends on the prompt's md5 only.

    With ``limit`` a longer prompt fails, as at a client whose context is exceeded.
    """
    def build():
        def answer(prompt: str) -> str:
            if limit is not None and len(prompt) > limit:
                raise ValueError("context length exceeded")
            n = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16)
            return json.dumps({"predicted_label": labels[n % len(labels)], "confidence": (n % 100) / 100})

        return answer

    return build


def mails(spark, d):
    """Documents as mails to classify; some bodies are blank."""
    blank = F.col("source") == "src3"
    return v.texts(spark, d).select("doc_id", F.col("lang").alias("true_label"), F.when(blank, "  ").otherwise(F.col("text")).alias("text"))


def keyed_mails(spark, d):
    """Mails whose cleaned body is not blank, with their cache key; cleaned once and written, as several joins read them."""
    rows = fixed(mails(spark, d), body=tx.truncate_words(tx.normalize_body("text"))).where("body <> ''")
    return materialize(rows.withColumn("key", tx.cache_key("zero", "holdout", "doc_id", "body", "m")).drop("body"), "keyed")


BODY = f"""mails AS (SELECT doc_id, lang AS true_label, {v.s_truncate(v.s_normalize_body("CASE WHEN source = 'src3' THEN '  ' ELSE text END"), 3000, " [TEXTO TRUNCADO]")} AS body FROM documents)"""


def asked(body: str) -> str:
    return f"('0x' || substr(md5(replace({ZERO}, '{{text}}', {body})), 1, 8))::BIGINT"


PICK = "list_extract(['de', 'en', 'es', 'fr'], n % 4 + 1)"


@query("answer_scoring", f"""WITH {BODY}, a AS (SELECT doc_id, true_label, body, {asked('body')} AS n FROM mails)
  SELECT doc_id, true_label, CASE WHEN body = '' THEN 'en' ELSE {PICK} END AS predicted_label, CASE WHEN body = '' THEN 0 ELSE round((n % 100) / 100, 6) END AS confidence,
  FALSE AS parse_error, CASE WHEN body = '' THEN 0 ELSE 1 END AS attempts FROM a""")
def answer_scoring(spark, d):
    out = sc.classify_answers(mails(spark, d), "doc_id", "text", digest_scorer(v.LANGS), v.LANGS, {}, "en", ZERO_SHOT, passes=1)
    return out.select("doc_id", "true_label", "predicted_label", F.round("confidence", 6).alias("confidence"), "parse_error", "attempts")


def _level(n: int) -> str:
    text = f"replace({ZERO}, '{{text}}', {v.s_shrink('body', n)})" if n else f"replace({ZERO}, '{{text}}', body)"
    return text


@query("retry_ladder", f"""WITH {BODY}, p AS (SELECT doc_id, true_label, body, {_level(0)} AS p0, {_level(1)} AS p1, {_level(2)} AS p2 FROM mails),
  c AS (SELECT *, CASE WHEN body = '' THEN 0 WHEN length(p0) <= {LIMIT} THEN 1 WHEN length(p1) <= {LIMIT} THEN 2 WHEN length(p2) <= {LIMIT} THEN 3 ELSE 4 END AS step FROM p),
  a AS (SELECT *, ('0x' || substr(md5(CASE step WHEN 1 THEN p0 WHEN 2 THEN p1 ELSE p2 END), 1, 8))::BIGINT AS n FROM c)
  SELECT doc_id, true_label, CASE WHEN step IN (0, 4) THEN 'en' ELSE {PICK} END AS predicted_label, CASE WHEN step IN (0, 4) THEN 0 ELSE round((n % 100) / 100, 6) END AS confidence,
  step = 4 AS parse_error, cast(least(step, 3) AS INTEGER) AS attempts FROM a""")
def retry_ladder(spark, d):
    """Three passes over a shrinking table: whole body, half, quarter; then the fallback."""
    out = sc.classify_answers(mails(spark, d), "doc_id", "text", digest_scorer(v.LANGS, LIMIT), v.LANGS, {}, "en", ZERO_SHOT)
    return out.select("doc_id", "true_label", "predicted_label", F.round("confidence", 6).alias("confidence"), "parse_error", "attempts")


@query("scorer_hook", """SELECT conv_id, turn, list_extract(['de', 'en', 'es', 'fr'], ('0x' || substr(md5(text), 1, 8))::BIGINT % 4 + 1) AS label FROM conversations""")
def scorer_hook(spark, d):
    """Any factory of a text-to-text client runs over a table; here on conversation turns."""
    rows = v.table(spark, d, "conversations").select("conv_id", "turn", "text")
    out = sc.ask(rows, "text", digest_scorer(v.LANGS))
    return out.select("conv_id", "turn", F.get_json_object("raw_response", "$.predicted_label").alias("label"))


@query("scored_through_cache", f"""WITH {BODY}, m AS (SELECT m.*, md5(concat_ws('|', 'zero', 'holdout', doc_id::VARCHAR, md5(body), 'm')) AS key FROM mails m WHERE body <> ''),
  a AS (SELECT m.*, {asked('body')} AS n FROM m) SELECT a.key, a.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'cached' ELSE {PICK} END AS predicted_label FROM a LEFT JOIN labels l ON l.doc_id = a.doc_id""")
def scored_through_cache(spark, d):
    """Rows found in a prediction cache keep it, the rest is asked."""
    rows = keyed_mails(spark, d)
    seen = v.table(spark, d, "labels").select("doc_id")
    cache = rows.join(seen, "doc_id", "left_semi").select("key", F.lit("cached").alias("predicted_label"))

    def score(misses):
        return sc.classify_answers(misses, "doc_id", "text", digest_scorer(v.LANGS), v.LANGS, {}, "en", passes=1)

    out = sc.with_cache(rows, cache, "key", score)
    return out.select("key", "doc_id", "predicted_label")


@query("answers_resumable", f"""WITH {BODY}, a AS (SELECT doc_id, true_label, body, {asked('body')} AS n FROM mails),
  s AS (SELECT *, CASE WHEN body = '' THEN 'en' ELSE {PICK} END AS predicted_label, CASE WHEN body = '' THEN 0 ELSE (n % 100) / 100 END AS confidence FROM a)
  SELECT 'zero_shot' AS strategy, true_label, predicted_label, cast(true_label = predicted_label AS INTEGER) AS is_correct, round(confidence, 6) AS confidence,
    0 AS parse_error, doc_id AS email_id, {", ".join(f"CASE WHEN body = '' THEN 0.25 WHEN predicted_label = '{l}' THEN 1 ELSE 0 END::DOUBLE AS score_{l}" for l in v.LANGS)} FROM s""")
def answers_resumable(spark, d):
    """Answers committed in chunks while the pass runs, exported wide: correctness, audit columns and one score per label."""
    out = sc.classify_answers(mails(spark, d), "doc_id", "text", digest_scorer(v.LANGS), v.LANGS, {}, "en", ZERO_SHOT, passes=1,
                              store=scratch_path(spark, "answering"), chunk=CHUNK)
    wide = sinks.wide_predictions(out.withColumn("email_id", F.col("doc_id")), v.LANGS, audit=["email_id"], strategy="zero_shot")
    return wide.select(*[F.round(c, 6).alias(c) if c == "confidence" or c.startswith("score_") else c for c in wide.columns])


# The prompt of a body: the few-shot template with the numbered block of the train rows' examples.
_FEW_PROMPT = f"replace(replace(replace({v.s_quote(FEW_SHOT)}, '{{labels}}', {v.s_quote(LABEL_LINES)}), '{{examples}}', examples), '{{text}}', body)"


@query("few_shot_answers", f"""WITH sp AS (SELECT doc_id, lang AS label, text, CASE WHEN {v.s_rank("lang", "doc_id")} <= round(count(*) OVER (PARTITION BY lang) * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM documents),
  b AS (SELECT doc_id, label, split, {v.s_truncate(v.s_normalize_body("text"), 3000, " [TEXTO TRUNCADO]")} AS body FROM sp),
  r AS (SELECT *, cast(length(body) BETWEEN 50 AND 500 AS INTEGER) AS in_band, md5(concat('42|', doc_id)) AS digest FROM b WHERE split = 'train' AND length(body) > 10),
  k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY in_band DESC, digest) AS rn, max(in_band) OVER (PARTITION BY label) AS best FROM r),
  few AS (SELECT row_number() OVER (ORDER BY md5(concat(digest, '|shuffle'))) AS example_no, label, {v.s_truncate("body", 400, " [...]")} AS example FROM k WHERE rn <= 1 AND in_band = best),
  block AS (SELECT coalesce(string_agg(concat('Ejemplo ', example_no, ':', chr(10), 'Texto del correo:', chr(10), example, chr(10), chr(10), 'Etiqueta correcta:', chr(10), label), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY example_no), '') AS examples FROM few),
  a AS (SELECT doc_id, label, body, ('0x' || substr(md5({_FEW_PROMPT}), 1, 8))::BIGINT AS n FROM b, block WHERE split = 'test')
  SELECT 'few_shot' AS strategy, doc_id, label AS true_label, CASE WHEN body = '' THEN 'en' ELSE {PICK} END AS predicted_label, CASE WHEN body = '' THEN 0 ELSE round((n % 100) / 100, 6) END AS confidence FROM a""")
def few_shot_answers(spark, d):
    """Few-shot classification end to end: examples from the train rows only, prompts and answers for the test rows."""
    docs = v.texts(spark, d).select("doc_id", "text", F.col("lang").alias("label"))
    rows = materialize(holdout(docs, "label", "doc_id"), "split")
    examples = few_shot(rows.where("split = 'train'"), v.LANGS, "doc_id", "text", "label")
    block = few_shot_block(examples).first()["examples"]  # one example per label of a closed list
    out = sc.classify_answers(rows.where("split = 'test'").drop("split"), "doc_id", "text", digest_scorer(v.LANGS), v.LANGS, {}, "en",
                              FEW_SHOT, examples=block, passes=1)
    return out.select(F.lit("few_shot").alias("strategy"), "doc_id", F.col("label").alias("true_label"), "predicted_label",
                      F.round("confidence", 6).alias("confidence"))


@query("answers_written_back", f"""WITH {BODY}, m AS (SELECT m.*, md5(concat_ws('|', 'zero', 'holdout', doc_id::VARCHAR, md5(body), 'm')) AS key FROM mails m WHERE body <> ''),
  a AS (SELECT m.*, {asked('body')} AS n FROM m) SELECT key, doc_id, {PICK} AS predicted_label, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS asked_in FROM a""")
def answers_written_back(spark, d):
    """Two runs through a stored table of answers: the second asks only what the first, over every other row, has not."""
    rows = keyed_mails(spark, d)
    store = BucketTable(spark, scratch_path(spark, "answers"), T.StructType.fromDDL("key string, predicted_label string, asked_in int"), ["key"])

    def score(run):
        return lambda misses: sc.classify_answers(misses, "doc_id", "text", digest_scorer(v.LANGS), v.LANGS, {}, "en", passes=1) \
            .withColumn("asked_in", F.lit(run))

    sc.through_store(rows.where("doc_id % 2 = 0"), store, "key", score(1))
    return sc.through_store(rows, store, "key", score(2)).select("key", "doc_id", "predicted_label", "asked_in")
