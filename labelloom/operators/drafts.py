"""Cleaning of generated mail drafts: reasoning blocks, subject, body and leftovers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import domain
from labelloom.functions.text import BLANK, looks_truncated, placeholders, strip, strip_reasoning

# Opening phrases and body tags that generators prepend.
PREAMBLE = r"(?i)\A(Claro[,.]?|Por supuesto[,.]?|Entendido[,.]?|Aquí tienes[,:]?|De acuerdo[,.]?|Perfecto[,.]?)[^\n]*\n+"
BODY_TAG = rf"(?i)\A\[?(BODY|CUERPO|EMAIL BODY|CORREO)[\]:]?[{BLANK}]*"


def extract_mail(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add status, subject, body, placeholders and truncated to raw drafts."""
    df = df.withColumn("__plain", strip_reasoning(raw))
    df = df.withColumn("__mail", strip(F.regexp_extract("__plain", r"(?is)\A.*(subject:.*)\z", 1)))
    df = df.withColumn("__mail", strip(F.regexp_replace("__mail", PREAMBLE, "")))
    status = (
        F.when(F.coalesce(F.col(raw), F.lit("")) == "", "empty")
        .when(F.col("__plain").isNull(), "open_reasoning")
        .when(F.col("__mail") == "", "no_subject")
        .otherwise("ok")
    )
    df = df.withColumn("status", status)
    df = df.withColumn(
        "__subject", strip(F.regexp_extract("__mail", rf"(?i)subject:[{BLANK}]*([^\n]+)", 1))
    )
    halves = F.split("__mail", "---+", 2)
    # Without a divider only the tag and one character after it are taken off.
    undivided = strip(F.regexp_replace("__mail", rf"(?i)subject:[{BLANK}]*[^\n]\n?", ""))
    df = df.withColumn("__body", F.when(F.size(halves) == 2, strip(F.element_at(halves, 2))).otherwise(undivided))
    df = df.withColumn("__body", F.regexp_replace("__body", BODY_TAG, ""))
    df = df.withColumn("__first", strip(F.substring_index("__body", "\n", 1)))
    repeats = (
        (F.col("__subject") != "") & (F.col("__first") != "")
        & F.lower("__subject").contains(F.lower(F.expr("substring(__first, 2)")))
    )
    # Without a newline the body is its first line only, and nothing remains.
    rest = F.when(F.instr("__body", "\n") > 0, strip(F.expr("substring(__body, instr(__body, '\n') + 1)"))).otherwise("")
    df = df.withColumn("__body", F.when(repeats, rest).otherwise(F.col("__body")))
    line = F.substring(F.substring_index("__body", "\n", 1), 1, 100)
    subject = F.when(F.col("__subject") != "", F.col("__subject")) \
        .when(F.col("__body") != "", line).otherwise(domain.NO_SUBJECT)
    body = F.when(F.col("__body") != "", F.col("__body")).otherwise(F.col("__mail"))
    ok = F.col("status") == "ok"
    failed = (
        F.when(F.col("status") == "open_reasoning", domain.FAILED_REASONING)
        .when(F.col("status") == "no_subject", domain.FAILED_FORMAT)
        .otherwise(domain.FAILED_BODY)
    )
    df = df.withColumn("__s", F.when(ok, subject).otherwise(domain.NO_SUBJECT))
    df = df.withColumn("body", F.when(ok, body).otherwise(failed))
    none = F.array().cast("array<string>")
    df = df.withColumn("placeholders", F.when(ok, placeholders("body", "__s")).otherwise(none))
    df = df.withColumn("truncated", ok & looks_truncated("body"))
    df = df.withColumn("subject", F.substring("__s", 1, 200))
    return df.drop("__plain", "__mail", "__subject", "__body", "__first", "__s")
