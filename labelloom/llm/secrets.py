"""Secret scans: a trigram inverted index picks candidate documents, regular expressions verify them.

Built-in DataFrame functions only. From every rule's regular expression a Boolean trigram query
is derived; postings (trigram, document) are kept for the trigrams that some query
names; a document is a rule's candidate if its postings meet the query. Only
candidates are matched. Rules without mandatory trigrams look at every document.

Offsets come from the pieces between the matches, so they count code points.

Defined results: a null text counts as empty and has no spans; rows with equal ids share
their postings (a document may be verified in vain, none is missed), and each row keeps its own spans; a null
id is an id of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The three kinds every scan has, in this order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE
SPANS = "_llm_secret_spans"  # reserved column name


def trigram_query(pattern: str, most: int = 64) -> list[list[frozenset[str]]]:
    """AND of ORs of trigram sets that every lower-cased match must contain.

    Runs of parts with few spellings are spelled out; each run gives one clause, with a
    set of trigrams per spelling. A run with a spelling under three characters gives none.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(run: set[str]) -> None:
        if run and all(len(s) >= 3 for s in run):
            clauses.append(sorted({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}, key=sorted))

    def spellings(node) -> set[str] | None:
        """All spellings of a part if they are few, else None."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            if any(k is not sre.LITERAL for k, _ in arg) or len(arg) > 8:
                return None
            return {chr(v).lower() for _, v in arg}
        if op is sre.SUBPATTERN:
            return listed(arg[-1])
        if op is sre.BRANCH:
            parts = [listed(p) for p in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op is sre.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            inner = listed(arg[2])
            return None if inner is None else inner | {""}
        return None

    def listed(parts) -> set[str] | None:
        out = {""}
        for node in parts:
            more = spellings(node)
            if more is None or len(out) * len(more) > most:
                return None
            out = {a + b for a in out for b in more}
        return out

    run = {""}
    for node in parser.parse(pattern):
        more = spellings(node)
        if more is None or len(run) * len(more) > most or "" in more and all(len(s) >= 3 for s in run):
            close(run)
            run = {""} if more is None else more
        else:
            run = {a + b for a in run for b in more}
    close(run)
    return clauses


def postings(docs: DataFrame, trigrams, id_col="doc_id", text_col="text") -> DataFrame:
    """Inverted index (trigram, id) of the given trigrams over lower-cased whole texts."""
    low = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    found = F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), g) for g in sorted(trigrams)])
    return docs.select(F.col(id_col).alias("id"), low.alias("low")).select(
        F.explode(F.array_compact(found)).alias("trigram"), "id")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(id, kinds): the rules whose trigram query the id's postings meet."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    clauses = [(kind, clause) for kind, q in queries.items() for clause in q]
    if not clauses:
        return index.groupBy("id").agg(F.array().cast("array<string>").alias("kinds"))
    # Postings meet in one row per id: a set of at most as many trigrams as the queries name.
    own = index.groupBy("id").agg(F.collect_set("trigram").alias("own"))

    def holds(clause):
        return reduce(lambda a, b: a | b, [
            reduce(lambda a, b: a & b, [F.array_contains("own", g) for g in sorted(s)]) for s in clause])

    kinds = F.array(*[F.when(reduce(lambda a, b: a & b, [holds(c) for c in q]), kind) for kind, q in queries.items() if q])
    return own.select("id", F.array_compact(kinds).alias("kinds")).where(F.size("kinds") > 0)


def _once(value: Column, make) -> Column:
    """``make`` of a value that is computed once, wherever ``make`` names it."""
    return F.transform(F.array(value), make)[0]


def _blocks(items: Column) -> Column:
    """The array cut into arrays of about the square root of its size: steps that append to an array stay cheap."""
    def cut(all_: Column) -> Column:
        n = F.size(all_)
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
        return F.when(n == 0, F.array(all_)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), width), lambda at: F.slice(all_, at, width)))

    return _once(items, cut)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, stop, order, kind) of one rule's matches in ``text``."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    sized = hits if rule.group == 0 else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    span = "struct<start:int,stop:int,order:int,kind:string>"

    def walked(block: Column, at: Column) -> Column:
        """(place after the block, its spans) when the block begins at ``at``."""
        return F.aggregate(
            block, F.struct(at.alias("at"), F.array().cast(f"array<{span}>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + F.coalesce(x["hit"], F.lit(0))).alias("at"),
                F.when(x["sized"] >= rule.least, F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["hit"]).alias("stop"),
                    F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"))))).otherwise(acc["out"]).alias("out")))

    def joined(acc: Column, block: Column) -> Column:
        return _once(walked(block, acc["at"]), lambda here: F.struct(
            here["at"].alias("at"), F.concat(acc["out"], F.array(here["out"])).alias("out")))

    whole = F.aggregate(_blocks(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), sized.alias("sized"))),
                        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{span}>>").alias("out")), joined)
    return F.flatten(whole["out"])


def _scan_pattern(rule: Rule) -> Rule:
    """A rule of one repeated class: runs shorter than the bound need not be matched to be dropped."""
    if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", rule.least)
    return rule


def scan(docs: DataFrame, id_col="doc_id", text_col="text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` with ``SPANS``, an array of (start, stop, order, kind) ordered by start, then rule."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    named = {g for q in queries.values() for clause in q for s in clause for g in s}
    found = candidates(postings(docs, named, id_col, text_col), rules).select(
        F.col("id").alias("_llm_secret_id"), F.col("kinds").alias("_llm_secret_kinds"))
    rows = docs.join(found, docs[id_col].eqNullSafe(found["_llm_secret_id"]), "left")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:int,stop:int,order:int,kind:string>>")
    parts = []
    for order, rule in enumerate(rules):
        own = _scan_pattern(rule)
        wanted = F.array_contains("_llm_secret_kinds", rule.kind) if queries[rule.kind] else text.rlike(own.pattern)
        parts.append(F.when(wanted, spans_of(text, own, order)).otherwise(none))
    spans = F.array_sort(F.concat(*parts), lambda a, b: F.when(
        (a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["order"] < b["order"]), -1).otherwise(
        F.when((a["start"] == b["start"]) & (a["order"] == b["order"]), 0).otherwise(1)))
    return rows.withColumn(SPANS, spans).drop("_llm_secret_id", "_llm_secret_kinds")


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                   s["stop"].cast("string"))), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``.

    Spans come in blocks, and the pieces of a block are cut from its own stretch of the text.
    """
    def inside(block: Column, base: Column, stretch: Column) -> Column:
        """The stretch, which begins at ``base`` and ends with the block's last span, with its marks."""
        pieces = F.aggregate(
            block, F.struct(base.alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, s: F.when(
                s["start"] < acc["at"],
                F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))).otherwise(
                F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(
                    F.substr(stretch, acc["at"] - base + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"))),
            lambda acc: acc["out"])
        return F.array_join(pieces, "")

    def joined(acc: Column, block: Column) -> Column:
        end = F.greatest(acc["at"], F.array_max(F.transform(block, lambda s: s["stop"])))
        return _once(end, lambda end: F.struct(end.alias("at"), F.concat(acc["out"], F.array(_once(
            F.substr(text, acc["at"] + 1, end - acc["at"]), lambda stretch: inside(block, acc["at"], stretch)))).alias("out")))

    whole = F.aggregate(_blocks(spans), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), joined,
                        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
