"""Input tables and the views derived from them, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.keys import draw, epoch_micros
from labelloom.session import bounded_values, spread

LANGS = ["de", "en", "es", "fr"]
VECTOR_LABELS = list(range(10))
ANSWER_ALIASES = {"english": "en", "francais": "fr"}
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
TDP, BASE_WATTS, CORES = 65.0, 10.0, 8


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def texts(spark, d) -> DataFrame:
    """Documents for work that scans whole texts: at least one partition per core."""
    return spread(documents(spark, d), "doc_id")


def emails(spark, d, heavy: bool = False, spam: bool = False) -> DataFrame:
    """Mails; ``labels`` is read and joined only for the ``is_spam`` column."""
    doc = texts(spark, d) if heavy else documents(spark, d)
    if spam:
        doc = doc.join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    multi = draw("doc_id", "multi") % 5 == 0
    flag = [(F.coalesce("toxic", F.lit(0)) == 1).alias("is_spam")] if spam else []
    return doc.select(
        F.col("doc_id").alias("email_id"),
        F.substring("text", 1, 40).alias("subject"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("BODY: "), "text")).otherwise(F.col("text")).alias("email_corpus"),
        F.col("lang").alias("class_label"),
        F.when(multi, F.col("source")).alias("secondary_label"),
        multi.alias("is_multi_intent"),
        (draw("doc_id", "amb") % 100 < 15).alias("is_ambiguous"),
        *flag,
        F.col("lang").alias("language"),
        (draw("doc_id", "tone") % 8).alias("tone"),
        (draw("doc_id", "noise") % 4).alias("noise_level"),
        F.col("source").alias("channel"),
    )


def vector_labels(spark, d) -> list:
    return bounded_values(table(spark, d, "embeddings"), "label")


def scores(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("true_label"))
    rows = e.withColumn("label", F.explode(F.array(*[F.lit(v) for v in vector_labels(spark, d)])))
    return rows.withColumn("score", _score())


def _score() -> Column:
    pair = F.concat_ws("-", F.col("row_id").cast("string"), F.col("label").cast("string"))
    bonus = F.when(F.col("label") == F.col("true_label"), 700).otherwise(0)
    return (draw(pair, "score") % 1000 + bonus) / F.lit(10000.0)


def predictions(spark, d) -> DataFrame:
    """Arg-max of the scores, taken inside the row."""
    pick = F.max_by(F.struct("label", "score"), F.struct("score", (-F.col("label")).alias("l")))
    return scores(spark, d).groupBy("row_id", "true_label").agg(pick.alias("p")) \
        .select("row_id", "true_label", F.col("p.label").alias("pred_label"), F.col("p.score").alias("confidence"))


def answers(spark, d) -> DataFrame:
    lang = F.col("lang")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    kind = draw("doc_id", "answer") % 8
    raw = (
        F.when(kind == 0, "").when(kind == 1, "no answer possible")
        .when(kind == 2, text('Sure: {"predicted_label": "', lang, '", "confidence": 1.7, "class_scores": {"', lang, '": 3,},} done'))
        .when(kind == 3, text('{"predicted_label": "', F.upper(lang), ' ", "confidence": "n/a"}'))
        .when(kind == 4, text('{"predicted_label": "', lang, '", "confidence": 0.5, "class_scores": {"en": 0.'))
        .when(kind == 5, '{"predicted_label": "unknown_thing", "confidence": 0.4, "class_scores": {}}')
        .otherwise(text('{"predicted_label": "', lang, '", "confidence": 0.9, "class_scores": {"', lang, '": 0.6, "en": 0.2}}'))
    )
    return documents(spark, d).select(F.col("doc_id").alias("row_id"), lang.alias("true_label"), raw.alias("raw_response"))


def candidates(spark, d) -> DataFrame:
    """Free-form spellings of a document's source."""
    src = F.col("source")
    kind = draw("doc_id", "cand") % 7
    raw = (
        F.when(kind == 0, src).when(kind == 1, F.concat(F.lit("  "), F.upper(src), F.lit(" ")))
        .when(kind == 2, F.concat(F.lit("the label is "), src)).when(kind == 3, F.concat(F.lit("mail-"), src))
        .when(kind == 4, F.substring(src, 1, 4)).when(kind == 5, F.replace(src, F.lit("r"), F.lit(""))).otherwise(F.concat(F.lit("alias "), src))
    )
    return documents(spark, d).select("doc_id", raw.alias("candidate"))


def samples(spark, d) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.select(
        F.col("user_id").alias("series_id"), "event_id", epoch_micros("ts").alias("t"), F.col("value").alias("watts"),
        (draw("event_id", "cpu") % 100).alias("cpu_percent"), (draw("event_id", "ram") % 4096).alias("ram_mb"),
    )


def binary(spark, d) -> DataFrame:
    """Toxic flag with a keyed score that leans towards the truth."""
    lab = table(spark, d, "labels")
    p = (draw("doc_id", "p") % 1000 + F.col("toxic") * 300) / F.lit(1300.0)
    return lab.select("doc_id", F.col("toxic").alias("y"), p.alias("p"))


def drafts(spark, d) -> DataFrame:
    """Raw generator output around each document, in every shape the cleaner knows."""
    line = F.regexp_replace(F.substring("text", 1, 60), r"\s+", " ")
    kind = draw("doc_id", "draft") % 10

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    body = F.col("text")
    raw = (
        F.when(kind == 0, "")
        .when(kind == 1, text("<|channel>thought plan SUBJECT: no<channel|> SUBJECT: ", line, "\n---\nBODY: ", body))
        .when(kind == 2, text("<|channel>thought ", body))
        .when(kind == 3, text("<think>hm ", line, "</think>\nSUBJECT: ", line, "\n-----\n", body))
        .when(kind == 4, body)
        .when(kind == 5, text("Claro, aquí tienes\nsubject: ", line, "\n---\n", line, "\n", body))
        .when(kind == 6, text("SUBJECT: Factura [Nombre]\n---\nHola [Nombre], [DNI]: ", body, " [x]"))
        .when(kind == 7, text("SUBJECT: ", line, "\n", body))
        .when(kind == 8, text("SUBJECT:\n---\n[CUERPO] ", body, "."))
        .otherwise(text("SUBJECT: ", line, "\n---\n", line))
    )
    return texts(spark, d).select("doc_id", raw.alias("raw"))


# SQL text of the same views.

def h(key: str, purpose: str) -> str:
    return f"('0x' || substr(md5(concat({key}, '|{purpose}')), 1, 15))::BIGINT"


def u(key: str, purpose: str) -> str:
    return f"({h(key, purpose)} / {float(1 << 60)!r}::DOUBLE)"


def micros(ts: str) -> str:
    return f"epoch_us({ts})"


SCORES = f"""scores AS (SELECT e.vec_id AS row_id, e.label AS true_label, c.label AS label,
  ({h("concat(e.vec_id, '-', c.label)", "score")} % 1000 + CASE WHEN c.label = e.label THEN 700 ELSE 0 END) / 10000::DOUBLE AS score
  FROM embeddings e CROSS JOIN (SELECT DISTINCT label FROM embeddings) c)"""
PREDICTIONS = SCORES + """, predictions AS (SELECT row_id, true_label, label AS pred_label, score AS confidence FROM (
  SELECT s.*, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label) AS rn FROM scores s) WHERE rn = 1)"""
EMAILS = f"""emails AS (SELECT d.doc_id AS email_id, substr(d.text, 1, 40) AS subject,
  CASE WHEN d.doc_id % 5 = 0 THEN concat('BODY: ', d.text) ELSE d.text END AS email_corpus, d.lang AS class_label,
  CASE WHEN {h("d.doc_id", "multi")} % 5 = 0 THEN d.source END AS secondary_label,
  {h("d.doc_id", "multi")} % 5 = 0 AS is_multi_intent, {h("d.doc_id", "amb")} % 100 < 15 AS is_ambiguous,
  coalesce(l.toxic, 0) = 1 AS is_spam, d.lang AS language, {h("d.doc_id", "tone")} % 8 AS tone,
  {h("d.doc_id", "noise")} % 4 AS noise_level, d.source AS channel
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
ANSWERS = f"""answers AS (SELECT doc_id AS row_id, lang AS true_label, CASE {h("doc_id", "answer")} % 8
  WHEN 0 THEN '' WHEN 1 THEN 'no answer possible'
  WHEN 2 THEN concat('Sure: {{"predicted_label": "', lang, '", "confidence": 1.7, "class_scores": {{"', lang, '": 3,}},}} done')
  WHEN 3 THEN concat('{{"predicted_label": "', upper(lang), ' ", "confidence": "n/a"}}')
  WHEN 4 THEN concat('{{"predicted_label": "', lang, '", "confidence": 0.5, "class_scores": {{"en": 0.')
  WHEN 5 THEN '{{"predicted_label": "unknown_thing", "confidence": 0.4, "class_scores": {{}}}}'
  ELSE concat('{{"predicted_label": "', lang, '", "confidence": 0.9, "class_scores": {{"', lang, '": 0.6, "en": 0.2}}}}') END AS raw_response
  FROM documents)"""
CANDIDATES = f"""candidates AS (SELECT doc_id, source, CASE {h("doc_id", "cand")} % 7 WHEN 0 THEN source
  WHEN 1 THEN concat('  ', upper(source), ' ') WHEN 2 THEN concat('the label is ', source) WHEN 3 THEN concat('mail-', source)
  WHEN 4 THEN substr(source, 1, 4) WHEN 5 THEN replace(source, 'r', '') ELSE concat('alias ', source) END AS candidate FROM documents)"""
SAMPLES = f"""samples AS (SELECT user_id AS series_id, event_id, epoch_us(ts) AS t, value AS watts,
  {h("event_id", "cpu")} % 100 AS cpu_percent, {h("event_id", "ram")} % 4096 AS ram_mb FROM events)"""
BINARY = f"""bin AS (SELECT doc_id, toxic AS y, ({h("doc_id", "p")} % 1000 + toxic * 300) / 1300::DOUBLE AS p FROM labels)"""
DRAFTS = f"""drafts0 AS (SELECT doc_id, text, regexp_replace(substr(text, 1, 60), '\\s+', ' ', 'g') AS line,
  {h("doc_id", "draft")} % 10 AS kind FROM documents),
drafts AS (SELECT doc_id, CASE kind WHEN 0 THEN ''
  WHEN 1 THEN concat('<|channel>thought plan SUBJECT: no<channel|> SUBJECT: ', line, chr(10), '---', chr(10), 'BODY: ', text)
  WHEN 2 THEN concat('<|channel>thought ', text)
  WHEN 3 THEN concat('<think>hm ', line, '</think>', chr(10), 'SUBJECT: ', line, chr(10), '-----', chr(10), text)
  WHEN 4 THEN text
  WHEN 5 THEN concat('Claro, aquí tienes', chr(10), 'subject: ', line, chr(10), '---', chr(10), line, chr(10), text)
  WHEN 6 THEN concat('SUBJECT: Factura [Nombre]', chr(10), '---', chr(10), 'Hola [Nombre], [DNI]: ', text, ' [x]')
  WHEN 7 THEN concat('SUBJECT: ', line, chr(10), text)
  WHEN 8 THEN concat('SUBJECT:', chr(10), '---', chr(10), '[CUERPO] ', text, '.')
  ELSE concat('SUBJECT: ', line, chr(10), '---', chr(10), line) END AS raw FROM drafts0)"""


# SQL text of the text functions.

BL = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def s_strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A[{BL}]+|[{BL}]+\z', '', 'g')"


def s_squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[{BL}]+', ' ', 'g'), ' ')"


def s_clean_latin(c: str) -> str:
    return s_squeeze(rf"regexp_replace(lower({c}), '[^a-záéíóúüñàèìòùâêîôûäëïöüa-z0-9\s]', ' ', 'g')")


def s_clean_ascii(c: str) -> str:
    return s_squeeze(rf"regexp_replace(lower({c}), '[^a-z0-9\s]', ' ', 'g')")


def s_clean_spam(c: str) -> str:
    no_url = rf"regexp_replace(lower({c}), 'http[^{BL}]+|www[^{BL}]+', ' ', 'g')"
    return s_squeeze(rf"regexp_replace(regexp_replace({no_url}, '\d+', ' ', 'g'), '[^a-z\s]', ' ', 'g')")


def s_normalize_body(c: str) -> str:
    inner = rf"regexp_replace(coalesce({c}, ''), '[ \t]+', ' ', 'g')"
    return s_strip(rf"regexp_replace({inner}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def s_last_blank(c: str) -> str:
    """0-based position of the last space, -1 when there is none."""
    return rf"(length({c}) - length(regexp_extract({c}, '[^ ]*\z')) - 1)"


def s_truncate(c: str, n: int, marker: str) -> str:
    head = f"substr({c}, 1, {n})"
    at = s_last_blank(head)
    return (f"CASE WHEN length({c}) > {n} THEN (CASE WHEN {at} > {0.8 * n}::DOUBLE THEN substr({head}, 1, {at}) "
            f"ELSE {head} END) || '{marker}' ELSE {c} END")


def s_cut(c: str, n: str) -> str:
    head = f"substr({c}, 1, {n})"
    at = s_last_blank(head)
    return f"(CASE WHEN {at} >= 0 THEN substr({head}, 1, {at}) ELSE {head} END)"


def s_shrink(c: str, level: int) -> str:
    m = " [TRUNCADO]"
    if level == 1:
        return f"{s_cut(c, f'greatest(400, length({c}) // 2)')} || '{m}'"
    if level == 2:
        return f"{s_cut(c, f'greatest(200, length({c}) // 4)')} || '{m}'"
    return f"CASE WHEN length({c}) > 200 THEN {s_cut(c, '200')} || '{m}' ELSE {c} END"


def s_words(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def s_blank_tokens(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '[{BL}]+'), lambda x: x <> '')"


def s_rank(by: str, key: str, seed: int = 42) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY md5(concat('{seed}|', {key})), {key})"


def s_quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
