"""Free-form model answers: JSON repair, label resolution and score completion.

Labels and aliases are closed lists, so they enter the plan as literals: no
join and no shuffle, however skewed the answers are.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import domain
from labelloom.functions.keys import _col
from labelloom.functions.text import json_block, lookup, strip

# Thresholds of the label cascade and the patterns of broken answers.
JACCARD_MIN = 0.4
SIMILARITY_MIN = 0.6
TRAILING_COMMA = r",\s*([\}\]])"
STATED_LABEL = r'"predicted_label"\s*:\s*"([^"]+)"'


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns computed once per row.

    A plain projection may be merged into the next one, and an expression used
    inside a lambda would then run once per list element. The one-row generator
    keeps the projections apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_object(c: Column) -> Column:
    """``map<string,string>`` of a JSON object; null unless the whole text is one object.

    Equal keys are all kept: read with ``last_value``. Nested values stay JSON text.
    """
    wrapped = F.concat(F.lit("["), c, F.lit("]"))
    parsed = F.from_json(wrapped, "array<map<string,string>>", {"allowSingleQuotes": "false"})
    return F.when(F.size(parsed) == 1, F.element_at(parsed, 1))


def last_value(obj: Column, key: Column) -> Column:
    """Value of a key; the last of equal keys counts. Null when absent."""
    found = F.filter(F.map_entries(obj), lambda e: e["key"] == key)
    return F.get(found, F.size(found) - 1)["value"]


def has_key(obj: Column, key: str) -> Column:
    return F.exists(F.map_keys(obj), lambda k: k == key)


def repair_commas(c: Column) -> Column:
    return F.regexp_replace(c, TRAILING_COMMA, "$1")


def salvage_label(c: Column) -> Column:
    found = F.regexp_extract(c, STATED_LABEL, 1)
    return strip(F.when(found != "", found))


def number(text: Column) -> Column:
    """A JSON number, numeric string or boolean as double; null for anything else."""
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))


def canonical(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))


def resolve_labels(df: DataFrame, raw: str, labels=domain.LABELS, aliases=domain.LABEL_ALIASES,
                   out: str = "label") -> DataFrame:
    """Alias, exact, unique two-way substring, best token overlap; else null."""
    known = _strings(labels)
    df = fixed(df, __cand=canonical(F.col(raw)))
    cand = F.col("__cand")
    own = F.filter(
        F.array_distinct(F.split(F.replace(cand, F.lit("-"), F.lit("_")), "_")), lambda t: F.length(t) > 2
    )
    # An empty candidate is contained in every label, so it never is a unique hit.
    hits = F.filter(known, lambda l: cand.contains(l) | l.contains(cand))
    df = fixed(df, __own=own, __hits=hits)
    scored = F.array(*[
        F.struct(
            (F.size(F.array_intersect("__own", words)) / F.size(F.array_union("__own", words))).alias("score"),
            F.lit(-i).alias("ord"), F.lit(l).alias("label"),
        )
        for i, (l, words) in enumerate((l, _strings(sorted(set(l.split("_"))))) for l in labels)
    ])
    df = fixed(df, __best=F.array_max(scored))
    label = F.coalesce(
        lookup(cand, aliases) if aliases else F.lit(None).cast("string"),
        F.when(F.array_contains(known, cand), cand),
        F.when(F.size("__hits") == 1, F.element_at("__hits", 1)),
        F.when((F.size("__own") > 0) & (F.col("__best.score") >= JACCARD_MIN), F.col("__best.label")),
    )
    return df.withColumn(out, label).drop("__cand", "__own", "__hits", "__best")


def normalize_scores(scores: Column) -> Column:
    """Divide a ``map<string,double>`` by its sum; all zero becomes uniform."""
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, v: a + v)
    return F.transform_values(
        scores, lambda _, v: F.when(total > 0, v / total).otherwise(1.0 / F.size(scores))
    )


def json_state(block: Column, direct: Column, mended: Column, saved: Column) -> Column:
    return (
        F.when(block.isNull(), "none").when(direct.isNotNull(), "ok").when(mended.isNotNull(), "repaired")
        .when(saved.isNotNull(), "salvaged").otherwise("broken")
    )


def read_json(df: DataFrame, raw: str) -> DataFrame:
    """Add json_state, __obj (parsed object or null) and __saved (label found by pattern)."""
    block = json_block(F.coalesce(F.col(raw), F.lit("")))
    df = fixed(df, __block=F.when(block != "", block))
    block = F.col("__block")
    df = fixed(df, __direct=parse_object(block), __saved=salvage_label(block))
    # Repair is tried only where the text did not parse as it came.
    mend = F.when(F.col("__direct").isNull(), repair_commas(block))
    df = fixed(df, __mended=parse_object(mend))
    state = json_state(block, F.col("__direct"), F.col("__mended"), F.col("__saved"))
    df = df.withColumn("json_state", state).withColumn("__obj", F.coalesce("__direct", "__mended"))
    return df.drop("__block", "__direct", "__mended")


def parse_answer(
    df: DataFrame,
    raw: str = "raw_response",
    labels=domain.LABELS,
    aliases=domain.LABEL_ALIASES,
    fallback: str = domain.FALLBACK_LABEL,
) -> DataFrame:
    """Add json_state, predicted_label, confidence, class_scores, parse_error, needs_retry."""
    known = _strings(labels)
    df = read_json(df, raw)
    obj = F.col("__obj")
    valid = obj.isNotNull()
    # A JSON null prints as "None" when turned into text, an absent key as "".
    told = F.when(has_key(obj, "predicted_label"), F.coalesce(last_value(obj, F.lit("predicted_label")), F.lit("None"))) \
        .otherwise("")
    df = fixed(df, __told=F.when(valid, strip(told)).otherwise(F.col("__saved")))
    df = resolve_labels(df, "__told", labels, aliases, "__near")
    exact = F.when(F.array_contains(known, F.col("__told")), F.col("__told"))
    # least and greatest skip nulls, so the missing number is filled before clamping.
    given = F.coalesce(number(last_value(obj, F.lit("confidence"))), F.lit(0.5))
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), given))
    stated = F.when(has_key(obj, "confidence"), clamped).otherwise(0.0)
    given = F.from_json(last_value(obj, F.lit("class_scores")), "map<string,string>", {"allowSingleQuotes": "false"})
    df = fixed(df, __label=F.coalesce(exact, F.col("__near")), __stated=stated, __given=given)
    ok = valid & F.col("__label").isNotNull()
    own = F.coalesce(F.col("__label"), F.lit(fallback))
    df = fixed(df, predicted_label=own, parse_error=~ok, confidence=F.when(ok, F.col("__stated")).otherwise(0.0))

    def filled(l: Column) -> Column:
        score = F.coalesce(number(last_value(F.col("__given"), l)), F.lit(0.0))
        mine = l == F.col("predicted_label")
        lifted = F.when(mine & (score == 0.0), F.greatest(F.col("confidence"), F.lit(0.01))).otherwise(score)
        one_hot = F.when(mine, 1.0).otherwise(0.0)
        return F.when(F.col("parse_error"), one_hot).otherwise(lifted)

    df = fixed(df, __scores=F.map_from_arrays(known, F.transform(known, filled)))
    df = df.withColumn("class_scores", normalize_scores(F.col("__scores")))
    df = df.withColumn("needs_retry", F.col("json_state").isin("none", "broken"))
    return df.drop("__obj", "__saved", "__told", "__near", "__label", "__stated", "__given", "__scores")


def closed_similarity(labels, similarity_min: float = SIMILARITY_MIN):
    """Pandas UDF for the one stage Spark has no expression for: sequence similarity.

    Only unresolved answers arrive non-null; each distinct value of a batch is
    compared once.
    """
    lowered = {l.lower(): l for l in labels}
    words = {l: set(re.findall(r"\w+", l.lower())) for l in labels}

    def nearest(cand: str) -> str:
        near = difflib.get_close_matches(cand.lower(), list(lowered), n=1, cutoff=similarity_min)
        if near:
            return lowered[near[0]]
        own = set(re.findall(r"\w+", cand.lower()))
        return max(labels, key=lambda l: len(own & words[l]))

    @F.pandas_udf("string")
    def match(cands: pd.Series) -> pd.Series:
        unique = {c: nearest(c) for c in set(cands.dropna())}
        return pd.Series([unique.get(c) for c in cands], dtype=object)

    return match


def _most_alike(text: Column, label: str) -> Column:
    """Upper bound of the sequence similarity of an ASCII text and a label: their shared characters, in any order."""
    counts = Counter(label.lower())
    shared = [F.least(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))), F.lit(n)) for c, n in sorted(counts.items())]
    total = reduce(lambda a, b: a + b, shared, F.lit(0))
    return F.when(F.length(text) + len(label) == 0, 1.0).otherwise(2.0 * total / (F.length(text) + len(label)))


def _most_words(text: Column, labels: list[str]) -> Column:
    """Label with the most words in common with an ASCII text, the first of equals."""
    own = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0)))
    shared = [F.struct(F.size(F.array_intersect(own, _strings(sorted(set(re.findall(r"\w+", l.lower())))))).alias("n"),
                       F.lit(-i).alias("ord"), F.lit(l).alias("l")) for i, l in enumerate(labels)]
    return F.array_max(F.array(*shared))["l"]


def resolve_closed(df: DataFrame, raw: str, labels, out: str = "label", compared: str | None = None,
                   similarity_min: float = SIMILARITY_MIN) -> DataFrame:
    """Map every answer to one of ``labels``; never null.

    Sequence similarity is computed in Python, for those distinct answers only whose characters could make a label reach
    ``similarity_min``; ``compared`` names a column that tells which rows these were.
    """
    labels = list(labels)
    cand = strip(F.regexp_replace(strip(raw), "\\A[\"'`.]+|[\"'`.]+\\z", ""))
    df = df.withColumn("__cand", cand)
    by_lower = {l.lower(): l for l in labels}
    exact = lookup(F.lower("__cand"), by_lower)
    first = strip(F.element_at(F.split("__cand", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), 1))
    line = lookup(F.lower(first), by_lower)
    low = F.lower("__cand")
    held = [
        F.when(low.contains(l.lower()), F.struct(F.lit(len(l)).alias("n"), F.lit(-i).alias("ord"), F.lit(l).alias("l")))
        for i, l in enumerate(labels)
    ]
    longest = F.array_max(F.array_compact(F.array(*held)))["l"]
    df = df.withColumn("__sure", F.when(F.col(raw).isNull(), F.lit(labels[0]))
                       .otherwise(F.coalesce(exact, line, longest)))
    # Only distinct answers that nothing else resolved and that may be alike enough go to Python.
    left = df.where(F.col("__sure").isNull()).select("__cand").distinct().withColumn("__low", F.lower("__cand"))
    plain = F.col("__cand").rlike(r"\A[\x00-\x7F]*\z")
    alike = reduce(lambda a, b: a | b, [_most_alike(F.col("__low"), l) >= similarity_min - 1e-9 for l in labels])
    left = left.withColumn("__asked", ~plain | alike)
    near = F.coalesce(closed_similarity(labels, similarity_min)(F.when(F.col("__asked"), F.col("__cand"))), _most_words(F.col("__low"), labels))
    near = left.select("__cand", "__asked", near.alias("__near"))
    df = df.join(near, "__cand", "left").withColumn(out, F.coalesce("__sure", "__near"))
    if compared:
        df = df.withColumn(compared, F.coalesce("__asked", F.lit(False)))
    return df.drop("__cand", "__sure", "__near", "__asked")
