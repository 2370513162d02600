"""Registered queries: text, hash, prompt and answer functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom import domain
from labelloom.functions import answers as an
from labelloom.functions import render as rd
from labelloom.functions import text as tx
from labelloom.functions.keys import draw
from labelloom.operators import profile as pf
from labelloom.operators.drafts import BODY_TAG, extract_mail
from labelloom.operators.planning import corpus_plan, render_plan
from labelloom.plans import views as v
from labelloom.plans.registry import query
from labelloom.session import bounded_values


def _doc_text(name, fn, sql_fn):
    """A query that applies one text function to every mail body."""
    @query(name, f"WITH {v.EMAILS} SELECT email_id, {sql_fn('email_corpus')} AS text FROM emails")
    def run(spark, d):
        return v.emails(spark, d, heavy=True).select("email_id", fn("email_corpus").alias("text"))

    return run


_doc_text("strip_body_prefix", tx.strip_prefix, lambda c: rf"regexp_replace({c}, '(?i)^body:[{v.BL}]*', '')")
_doc_text("clean_text_latin", tx.clean_latin, v.s_clean_latin)
_doc_text("clean_text_ascii", tx.clean_ascii, v.s_clean_ascii)
_doc_text("clean_text_spam", tx.clean_spam, v.s_clean_spam)
_doc_text("squeeze_blanks", tx.squeeze, v.s_squeeze)
_doc_text("normalize_body", tx.normalize_body, v.s_normalize_body)
_doc_text("tokenize_blank", lambda c: F.array_join(tx.tokens(c), "|"),
          lambda c: f"array_to_string({v.s_blank_tokens(c)}, '|')")
_doc_text("tokenize_word2", lambda c: F.array_join(tx.word_tokens(c), "|"),
          lambda c: f"array_to_string({v.s_words(c)}, '|')")
_doc_text("text_fingerprint", tx.fingerprint, lambda c: f"md5({c})")


@query("truncate_words", f"""WITH {v.EMAILS}, n AS (SELECT email_id, {v.s_normalize_body("email_corpus")} AS b FROM emails)
  SELECT email_id, {v.s_truncate("b", 3000, " [TEXTO TRUNCADO]")} AS body, {v.s_truncate("b", 400, " [...]")} AS example FROM n""")
def truncate_words(spark, d):
    rows = v.emails(spark, d, heavy=True).select("email_id", tx.normalize_body("email_corpus").alias("b"))
    return rows.select("email_id", tx.truncate_words("b").alias("body"),
                       tx.truncate_words("b", domain.MAX_EXAMPLE_CHARS, domain.EXAMPLE_MARKER).alias("example"))


@query("shrink_levels", f"""WITH {v.EMAILS}, n AS (SELECT email_id, {v.s_normalize_body("email_corpus")} AS b FROM emails)
  SELECT email_id, 1 AS level, {v.s_shrink("b", 1)} AS text FROM n UNION ALL
  SELECT email_id, 2, {v.s_shrink("b", 2)} FROM n UNION ALL SELECT email_id, 3, {v.s_shrink("b", 3)} FROM n""")
def shrink_levels(spark, d):
    rows = v.emails(spark, d, heavy=True).select("email_id", tx.normalize_body("email_corpus").alias("b"))
    return rows.select("email_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("level"), tx.shrink("b", i).alias("text")) for i in (1, 2, 3)])))


@query("cache_key", """SELECT doc_id, md5(concat_ws('|', 'zero_shot', 'holdout', CASE WHEN source = 'src0' THEN 'noid' ELSE doc_id::VARCHAR END,
  md5(text), 'model-a')) AS key FROM documents""")
def cache_key(spark, d):
    row_id = F.when(F.col("source") != "src0", F.col("doc_id"))
    return v.documents(spark, d).select("doc_id", tx.cache_key("zero_shot", "holdout", row_id, "text", "model-a").alias("key"))


def _power_sql(prime: int) -> str:
    """The digest's base to the power e, by squares."""
    return (f"list_reduce(list_concat([1::BIGINT], range(40, -1, -1)), lambda a, bit: "
            f"(a * a % {prime}) * CASE WHEN (e >> bit) & 1 = 1 THEN {pf.DIGEST_BASE} ELSE 1 END % {prime})")


_HEX = "||".join(f"printf('%08x', (sum((('0x' || substr(m, {at}, 15))::BIGINT % {p}) * {_power_sql(p)} % {p}) % {p})::BIGINT)"
                 for at, p in zip((1, 17), pf.DIGEST_PRIMES))


@query("corpus_digest", f"""WITH r AS (SELECT doc_id, md5(concat_ws('|', coalesce(doc_id::VARCHAR, chr(0)), coalesce(text, chr(0)))) AS m FROM documents),
  o AS (SELECT m, count(*) OVER () - row_number() OVER (ORDER BY doc_id NULLS FIRST, m) AS e FROM r)
  SELECT count(*) AS n, {_HEX} AS digest FROM o""")
def corpus_digest(spark, d):
    """Sixteen digits that change with any text, any id and the order of the rows by id."""
    return pf.ordered_digest(v.documents(spark, d), "doc_id", "text")


LABEL_LINES = rd.label_block(v.LANGS)
ZERO = v.s_quote(rd.ZERO_SHOT).replace("{labels}", LABEL_LINES)


@query("render_prompt", f"""WITH {v.EMAILS}, b AS (SELECT email_id, class_label, {v.s_truncate(v.s_normalize_body("email_corpus"), 3000, " [TEXTO TRUNCADO]")} AS body FROM emails)
  SELECT email_id, replace({ZERO}, '{{text}}', body) AS zero_shot,
  replace(replace({v.s_quote(rd.FEW_SHOT)}, '{{labels}}', {v.s_quote(LABEL_LINES)}), '{{text}}', body) AS few_shot,
  concat('system|', replace({v.s_quote(rd.CHAT_SYSTEM)}, '{{labels}}', {v.s_quote(LABEL_LINES)}), '||user|', body, '||assistant|', class_label) AS chat FROM b""")
def render_prompt(spark, d):
    body = tx.truncate_words(tx.normalize_body("email_corpus"))
    rows = v.emails(spark, d, heavy=True).select("email_id", "class_label", body.alias("body"))
    turns = F.transform(rd.chat("body", v.LANGS, "class_label"), lambda t: F.concat(t["role"], F.lit("|"), t["content"]))
    return rows.select(
        "email_id", rd.render("body", v.LANGS).alias("zero_shot"),
        rd.render("body", v.LANGS, rd.FEW_SHOT, examples="{examples}").alias("few_shot"),
        F.array_join(turns, "||").alias("chat"),
    )


def plan_sql() -> str:
    def weighted(purpose, weights):
        from labelloom.operators.planning import cumulative

        bounds = cumulative(weights)
        whens = " ".join(f"WHEN {v.u('doc_id', purpose)} < {hi!r}::DOUBLE THEN '{n}'" for n, hi in bounds[:-1])
        return f"CASE {whens} ELSE '{bounds[-1][0]}' END"

    def uniform(purpose, values):
        return f"list_extract([{', '.join(v.s_quote(x) for x in values)}], {v.h('doc_id', purpose)} % {len(values)} + 1)"

    labels = "[" + ", ".join(v.s_quote(x) for x in domain.LABELS) + "]"
    spam = ", ".join(v.s_quote(x) for x in domain.SPAM_CLASSES)
    return f"""p0 AS (SELECT doc_id, {weighted("class", domain.WEIGHTS)} AS class_label FROM documents),
p1 AS (SELECT *, list_position({labels}, class_label) - 1 AS own, {v.h("doc_id", "secondary")} % 34 AS oth FROM p0),
p2 AS (SELECT *, CASE WHEN {v.u("doc_id", "multi_intent")} < 0.2::DOUBLE
  THEN list_extract({labels}, CASE WHEN oth >= own THEN oth + 1 ELSE oth END + 1) END AS secondary_label FROM p1),
plan AS (SELECT doc_id AS email_id, class_label, secondary_label, secondary_label IS NOT NULL AS is_multi_intent,
  {v.u("doc_id", "ambiguous")} < 0.15::DOUBLE AND secondary_label IS NULL AS is_ambiguous,
  class_label IN ({spam}) OR {v.u("doc_id", "spam")} < 0.08::DOUBLE AS is_spam,
  CASE WHEN {v.h("doc_id", "language")} % 5 < 4 THEN 'es' ELSE 'en' END AS language,
  {uniform("tone", domain.TONES)} AS tone, {uniform("profile", domain.SENDER_PROFILES)} AS sender_profile,
  {weighted("length", domain.LENGTH_WEIGHTS)} AS email_length, {weighted("noise", domain.NOISE_WEIGHTS)} AS noise_level,
  {uniform("channel", domain.CHANNELS)} AS channel,
  round(0.65::DOUBLE + {v.u("doc_id", "temperature")} * 0.40::DOUBLE, 2) AS temperature,
  round(0.30::DOUBLE + {v.u("doc_id", "top_p")} * 0.48::DOUBLE, 2) AS top_p,
  cast({v.h("doc_id", "top_k")} % 50 + 30 AS INTEGER) AS top_k, cast({v.h("doc_id", "seed")} % 99998 + 1 AS INTEGER) AS seed FROM p2)"""


PLAN = plan_sql()


def _hint(column, mapping, default):
    whens = " ".join(f"WHEN {v.s_quote(k)} THEN {v.s_quote(x)}" for k, x in mapping.items())
    return f"CASE {column} {whens} ELSE {v.s_quote(default)} END"


def _render_sql() -> str:
    slots = {
        "class_label": "class_label", "class_description": _hint("class_label", domain.DESCRIPTIONS, domain.DEFAULT_CLASS_HINT),
        "sender_profile": "sender_profile", "tone": "tone", "channel": "channel",
        "language": "CASE WHEN language = 'en' THEN 'en inglés (English)' ELSE 'en español' END",
        "length_hint": _hint("email_length", domain.LENGTH_HINTS, domain.DEFAULT_LENGTH_HINT),
        "noise_hint": _hint("noise_level", domain.NOISE_HINTS, domain.DEFAULT_NOISE_HINT),
        "secondary_hint": "CASE WHEN is_multi_intent THEN concat('Intención secundaria: ', secondary_label, ' (', "
                          + _hint("secondary_label", domain.DESCRIPTIONS, "") + ", ').') ELSE '' END",
        "ambiguity_hint": "CASE WHEN is_ambiguous THEN 'Debe ser ambiguo.' ELSE '' END",
    }

    def one(t):
        e = v.s_quote(t)
        for k, x in slots.items():
            e = f"replace({e}, '{{{k}}}', {x})"
        return e

    whens = " ".join(f"WHEN {i} THEN {one(t)}" for i, t in enumerate(rd.PLAN_TEMPLATES))
    n = len(rd.PLAN_TEMPLATES)
    return f"""WITH {PLAN}, r AS (SELECT *, (row_number() OVER (ORDER BY email_id) - 1) % {n} AS turn FROM plan)
  SELECT email_id, concat('plantilla_', turn + 1) AS template_id, CASE turn {whens} END AS prompt FROM r"""


@query("render_generation_prompt", _render_sql())
def render_generation_prompt(spark, d):
    plan = corpus_plan(v.documents(spark, d), "doc_id")
    return render_plan(plan).select("email_id", "template_id", "prompt")


PLAIN = f"""plain AS (SELECT doc_id, raw, CASE WHEN NOT contains(raw, '<|channel>thought') THEN {v.s_strip("regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g')")}
  WHEN contains(raw, '<channel|>') THEN {v.s_strip("regexp_replace(" + v.s_strip("regexp_extract(raw, '(?s).*<channel[|]>(.*)', 1)") + ", '(?is)<think>.*?</think>', '', 'g')")} END AS plain FROM drafts)"""


@query("strip_reasoning", f"WITH {v.DRAFTS}, {PLAIN} SELECT doc_id, coalesce(plain, '<open>') AS plain FROM plain")
def strip_reasoning(spark, d):
    return v.drafts(spark, d).select("doc_id", F.coalesce(tx.strip_reasoning("raw"), F.lit("<open>")).alias("plain"))


TAG = BODY_TAG.replace(tx.BLANK, v.BL)
MAIL_SQL = rf"""WITH {v.DRAFTS}, {PLAIN},
m0 AS (SELECT doc_id, raw, plain, {v.s_strip("regexp_extract(plain, '(?is)^.*(subject:.*)$', 1)")} AS mail FROM plain),
m1 AS (SELECT *, CASE WHEN raw = '' THEN 'empty' WHEN plain IS NULL THEN 'open_reasoning' WHEN coalesce(mail, '') = '' THEN 'no_subject' ELSE 'ok' END AS status,
  {v.s_strip(rf"regexp_extract(mail, '(?i)subject:[{v.BL}]*([^\n]+)', 1)")} AS sub FROM m0),
m2 AS (SELECT *, CASE WHEN regexp_matches(mail, '---+') THEN {v.s_strip("regexp_replace(mail, '(?s)^.*?---+', '')")}
  ELSE {v.s_strip(rf"regexp_replace(mail, '(?i)subject:[{v.BL}]*[^\n]\n?', '', 'g')")} END AS body0 FROM m1),
m3 AS (SELECT *, regexp_replace(body0, '{TAG}', '') AS body1 FROM m2),
m4 AS (SELECT *, {v.s_strip("split_part(body1, chr(10), 1)")} AS first FROM m3),
m5 AS (SELECT *, CASE WHEN sub <> '' AND first <> '' AND contains(lower(sub), lower(substr(first, 2)))
  THEN (CASE WHEN instr(body1, chr(10)) > 0 THEN {v.s_strip("substr(body1, instr(body1, chr(10)) + 1)")} ELSE '' END) ELSE body1 END AS body2 FROM m4),
m6 AS (SELECT doc_id, status, CASE WHEN status <> 'ok' THEN '[Sin asunto]' WHEN sub <> '' THEN sub WHEN body2 <> '' THEN substr(split_part(body2, chr(10), 1), 1, 100) ELSE '[Sin asunto]' END AS s,
  CASE status WHEN 'ok' THEN (CASE WHEN body2 <> '' THEN body2 ELSE mail END) WHEN 'open_reasoning' THEN '{domain.FAILED_REASONING}'
  WHEN 'no_subject' THEN '{domain.FAILED_FORMAT}' ELSE '{domain.FAILED_BODY}' END AS body FROM m5)"""


@query("extract_subject_body", MAIL_SQL + " SELECT doc_id, status, substr(s, 1, 200) AS subject, body FROM m6")
def extract_subject_body(spark, d):
    return extract_mail(v.drafts(spark, d)).select("doc_id", "status", "subject", "body")


@query("placeholder_scan", MAIL_SQL + r""", p AS (SELECT doc_id, CASE WHEN status = 'ok' THEN list_sort(list_distinct(regexp_extract_all(concat_ws(' ', body, s), '\[[^\]]{2,40}\]'))) ELSE [] END AS f FROM m6)
  SELECT doc_id, array_to_string(f, '|') AS found, len(f) > 0 AS has_placeholder FROM p""")
def placeholder_scan(spark, d):
    return extract_mail(v.drafts(spark, d)).select(
        "doc_id", F.array_join("placeholders", "|").alias("found"), (F.size("placeholders") > 0).alias("has_placeholder"))


@query("truncated_flag", MAIL_SQL + rf""" SELECT doc_id, status = 'ok' AND body <> '' AND NOT regexp_matches(body, '[.!?»"''][{v.BL}]*\z') AS truncated FROM m6""")
def truncated_flag(spark, d):
    return extract_mail(v.drafts(spark, d)).select("doc_id", "truncated")


BLOCK = "regexp_extract(raw_response, '(?s)\\{.*\\}')"


@query("json_block", f"WITH {v.ANSWERS} SELECT row_id, {BLOCK} AS block FROM answers")
def json_block(spark, d):
    return v.answers(spark, d).select("row_id", tx.json_block("raw_response").alias("block"))


J0 = rf"""j0 AS (SELECT row_id, true_label, raw_response, {BLOCK} AS block FROM answers),
j1 AS (SELECT *, CASE WHEN block <> '' AND json_valid(block) AND NOT regexp_matches(block, ',\s*[\}}\]]') THEN block END AS direct, regexp_replace(block, ',\s*([\}}\]])', '\1', 'g') AS fixed,
  nullif(regexp_extract(block, '"predicted_label"\s*:\s*"([^"]+)"', 1), '') AS saved FROM j0),
j2 AS (SELECT *, coalesce(direct, CASE WHEN fixed <> '' AND json_valid(fixed) THEN fixed END) AS obj FROM j1),
j3 AS (SELECT *, CASE WHEN block = '' THEN 'none' WHEN direct IS NOT NULL THEN 'ok' WHEN obj IS NOT NULL THEN 'repaired'
  WHEN saved IS NOT NULL THEN 'salvaged' ELSE 'broken' END AS json_state FROM j2)"""


@query("json_repair", f"""WITH {v.ANSWERS}, {J0} SELECT row_id, json_state,
  coalesce(CASE WHEN json_state = 'salvaged' THEN {v.s_strip("saved")} ELSE json_extract_string(obj, '$.predicted_label') END, '<none>') AS stated FROM j3""")
def json_repair(spark, d):
    rows = an.read_json(v.answers(spark, d), "raw_response")
    told = an.last_value(F.col("__obj"), F.lit("predicted_label"))
    stated = F.when(F.col("json_state") == "salvaged", F.col("__saved")).otherwise(told)
    return rows.select("row_id", "json_state", F.coalesce(stated, F.lit("<none>")).alias("stated"))


def resolve_sql(cand: str, labels: list[str], aliases: dict[str, str]) -> str:
    """Label cascade as one SQL expression over a list of labels."""
    ls = "[" + ", ".join(v.s_quote(x) for x in labels) + "]"
    clean = f"replace(lower({v.s_strip(cand)}), ' ', '_')"
    alias = " ".join(f"WHEN {v.s_quote(a)} THEN {v.s_quote(x)}" for a, x in aliases.items())
    alias = f"CASE {clean} {alias} END" if alias else "NULL"
    hits = f"list_filter({ls}, lambda l: contains({clean}, l) OR contains(l, {clean}))"
    own = f"list_filter(list_distinct(string_split(replace({clean}, '-', '_'), '_')), lambda t: length(t) > 2)"
    share = (f"len(list_intersect({own}, string_split(l, '_'))) / "
             f"len(list_distinct(list_concat({own}, string_split(l, '_'))))::DOUBLE")
    scored = f"list_transform({ls}, lambda l, i: {{'s': {share}, 'o': -i, 'l': l}})"
    best = f"list_extract(list_reverse_sort({scored}), 1)"
    overlap = f"CASE WHEN len({own}) > 0 AND {best}.s >= 0.4::DOUBLE THEN {best}.l END"
    return (f"coalesce({alias}, CASE WHEN list_contains({ls}, {clean}) THEN {clean} END, "
            f"CASE WHEN len({hits}) = 1 THEN list_extract({hits}, 1) END, {overlap})")


SOURCES = [f"src{i}" for i in range(20)]
SOURCE_ALIASES = {f"alias_src{i}": f"src{i}" for i in range(0, 20, 2)}


@query("resolve_label", f"""WITH {v.CANDIDATES} SELECT doc_id, candidate,
  coalesce({resolve_sql("candidate", SOURCES, SOURCE_ALIASES)}, '<none>') AS label FROM candidates""")
def resolve_label(spark, d):
    rows = v.candidates(spark, d)
    rows = an.resolve_labels(rows, "candidate", SOURCES, SOURCE_ALIASES)
    return rows.select("doc_id", "candidate", F.coalesce("label", F.lit("<none>")).alias("label"))


@query("resolve_label_closed")
def resolve_label_closed(spark, d):
    docs = v.documents(spark, d)
    labels = bounded_values(docs, "source")
    out = an.resolve_closed(v.candidates(spark, d), "candidate", labels, compared="compared")
    return out.select("doc_id", "candidate", "label", "compared")


L4 = "[" + ", ".join(v.s_quote(x) for x in v.LANGS) + "]"
PARSE = rf"""{J0}, j4 AS (SELECT *, CASE WHEN obj IS NOT NULL THEN {v.s_strip("coalesce(json_extract_string(obj, '$.predicted_label'), CASE WHEN json_exists(obj, '$.predicted_label') THEN 'None' ELSE '' END)")}
  ELSE {v.s_strip("saved")} END AS cand FROM j3),
j5 AS (SELECT *, CASE WHEN list_contains({L4}, cand) THEN cand ELSE {resolve_sql("cand", v.LANGS, v.ANSWER_ALIASES)} END AS res FROM j4),
j6 AS (SELECT *, obj IS NOT NULL AND res IS NOT NULL AS ok FROM j5),
j7 AS (SELECT *, CASE WHEN NOT ok THEN 0::DOUBLE WHEN NOT json_exists(obj, '$.confidence') THEN 0::DOUBLE
  ELSE least(1::DOUBLE, greatest(0::DOUBLE, coalesce(try_cast(json_extract_string(obj, '$.confidence') AS DOUBLE), 0.5::DOUBLE))) END AS confidence,
  coalesce(res, 'en') AS predicted_label FROM j6),
parsed AS (SELECT row_id, true_label, predicted_label, confidence, NOT ok AS parse_error, json_state IN ('none', 'broken') AS needs_retry, ok, obj FROM j7)"""


@query("parse_answer", f"""WITH {v.ANSWERS}, {PARSE} SELECT row_id, true_label, predicted_label, round(confidence, 6) AS confidence, parse_error, needs_retry FROM parsed""")
def parse_answer(spark, d):
    out = an.parse_answer(v.answers(spark, d), labels=v.LANGS, aliases=v.ANSWER_ALIASES, fallback="en")
    return out.select("row_id", "true_label", "predicted_label", F.round("confidence", 6).alias("confidence"), "parse_error", "needs_retry")


@query("normalize_scores", f"""WITH {v.ANSWERS}, {PARSE}, s0 AS (SELECT p.*, l.label, coalesce(try_cast(json_extract_string(obj, '$.class_scores.' || l.label) AS DOUBLE), 0) AS given
  FROM parsed p CROSS JOIN (SELECT unnest({L4}) AS label) l),
s1 AS (SELECT row_id, label, CASE WHEN NOT ok THEN (CASE WHEN label = predicted_label THEN 1 ELSE 0 END)
  WHEN label = predicted_label AND given = 0 THEN greatest(confidence, 0.01::DOUBLE) ELSE given END::DOUBLE AS score FROM s0)
  SELECT row_id, label, round(CASE WHEN sum(score) OVER (PARTITION BY row_id) > 0 THEN score / sum(score) OVER (PARTITION BY row_id) ELSE 0.25::DOUBLE END, 6) AS score FROM s1""")
def normalize_scores(spark, d):
    out = an.parse_answer(v.answers(spark, d), labels=v.LANGS, aliases=v.ANSWER_ALIASES, fallback="en")
    return out.select("row_id", F.explode("class_scores").alias("label", "s")).select("row_id", "label", F.round("s", 6).alias("score"))


HINTS = {"de": "alemán", "en": "inglés", "fr": "francés"}


@query("map_lookup_default", f"SELECT doc_id, {_hint('lang', HINTS, 'otro idioma')} AS hint FROM documents")
def map_lookup_default(spark, d):
    return v.documents(spark, d).select("doc_id", tx.lookup("lang", HINTS, "otro idioma").alias("hint"))


SFT_SYSTEM = v.s_quote(rd.CHAT_SYSTEM).replace("{labels}", LABEL_LINES)
SFT_ROOM = rd.text_budget(v.LANGS)


@query("sft_examples", rf"""WITH b AS (SELECT doc_id, lang, array_to_string(({v.s_blank_tokens("text")})[1:{SFT_ROOM}], ' ') AS body FROM documents)
  SELECT doc_id, concat('system|', {SFT_SYSTEM}, '||user|', body, '||assistant|', lang) AS chat,
  cast(length({SFT_SYSTEM}) + length(body) AS BIGINT) AS prompt_len, lang AS answer FROM b""")
def sft_examples(spark, d):
    """Chat examples within the default token budget; the prompt part is masked."""
    rows = v.texts(spark, d).select("doc_id", "lang", rd.sft_example("text", v.LANGS, "lang").alias("e"))
    shown = F.array_join(F.transform("e.chat", lambda t: F.concat(t["role"], F.lit("|"), t["content"])), "||")
    return rows.select("doc_id", shown.alias("chat"), "e.prompt_len", F.col("lang").alias("answer"))
