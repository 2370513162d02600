"""Registered queries of the two operators built from DataFrame functions alone, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.llm import chat, secrets
from labelloom.llm.registry import query

PROBE_TEXT = r"\### Assistant: </turn> ok"


def _duck_spans(rule, order):
    """DuckDB list of the spans of one rule over the column t."""
    p = rule.pattern.replace("'", "''")
    return f"""(SELECT coalesce(list({{'s': s, 'o': {order}, 'x': '{rule.kind}:' || s || ':' || e}}), [])
      FROM (SELECT coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS s,
                   s + length(h[i]) AS e, length(z[i]) AS n
            FROM (SELECT string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS h, regexp_extract_all(t, '{p}', {rule.group}) AS z),
                 range(1, len(h) + 1) r(i)) WHERE n >= {rule.least})"""


_LISTS = ", ".join(f"{_duck_spans(r, i)} AS l{i}" for i, r in enumerate(secrets.RULES))
_JOINED = "list_concat(" * 6 + "l0" + "".join(f", l{i})" for i in range(1, 7))
OP7_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {_LISTS} FROM d),
  s AS (SELECT doc_id, l0, l1, l2, list_sort(list_concat(list_concat(l0, l1), l2)) AS b, list_sort({_JOINED}) AS a FROM f)
  SELECT doc_id, len(l0)::BIGINT AS n_assign, len(l1)::BIGINT AS n_access, len(l2)::BIGINT AS n_hex,
    sha256(array_to_string(list_transform(b, lambda x: x.x), ',')) AS base_sha256, array_to_string(list_transform(a, lambda x: x.x), ',') AS spans FROM s"""


@query("op7_secret_scan", OP7_SQL)
def op7_secret_scan(spark, d):
    """Secrets of every document: counts of the base kinds, their digest, and all spans."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    found = secrets.scan(docs)
    spans = F.col(secrets.SPANS)

    def number(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["order"] < len(secrets.BASE))
    return found.select("doc_id", *[number(r.kind) for r in secrets.BASE],
                        F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(spans).alias("spans"))


_ESC = r"replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')"
_STEPS = ", ".join(f"'{a}>{b}'" for a, nexts in chat.TEMPLATE.follows.items() for b in nexts)
_LAST = ", ".join(f"'{r}'" for r in chat.TEMPLATE.last)
_SAID = "coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10)"


@query("op9_chat_format", f"""WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE_TEXT}')
  , o AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(lag(role) OVER w, '') || '>' || role AS step FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg({_SAID}, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(4 + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
        ELSE 2 + length(replace(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), '#', '\\h'), ':', '\\c')) END + 2 + length({_ESC}) + 8)::BIGINT AS formatted_chars,
    min(i) FILTER (step NOT IN ({_STEPS})) AS first_bad, count(*) FILTER (step NOT IN ({_STEPS})) = 0 AND arg_max(role, i) IN ({_LAST}) AS valid_order
  FROM o GROUP BY conv_id""")
def op9_chat_format(spark, d):
    """Every conversation formatted by the template, what is read back from the result, and what the machine says of its turn order."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)],
                                  "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(rows.unionByName(probe))
    back = chats.select("conv_id", "formatted", "valid_order", "first_bad", chat.read_chats(F.col("formatted")).alias("turns"),
                        chat.trained_text(F.col("segments")).alias("trained"))
    said = F.array_join(F.transform("turns", lambda s: F.concat(s["role"], F.lit("\n"), s["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"), F.sha2(F.col("trained"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "first_bad", "valid_order")
