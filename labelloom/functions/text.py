"""Text functions as column expressions: they stay in the JVM and in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import domain
from labelloom.functions.keys import _col

# Every character Unicode counts as a blank, spelled for Java regular expressions.
BLANK = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"

# The characters that survive cleaning, and the patterns of tags and marks.
LATIN_KEEP = "a-z0-9áéíóúüñàèìòùâêîôûäëïö"
ASCII_KEEP = "a-z0-9"
LETTER_KEEP = "a-z"
URL = rf"http[^{BLANK}]+|www[^{BLANK}]+"
BODY_PREFIX = rf"(?i)^body:[{BLANK}]*"
WORD = r"[\p{L}\p{N}_]{2,}"
PLACEHOLDER = r"\[[^\]]{2,40}\]"
SENTENCE_END = rf"""[.!?»"'][{BLANK}]*\z"""


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c) -> Column:
    """Trim every kind of blank on both sides."""
    return F.regexp_replace(_col(c), rf"\A[{BLANK}]+|[{BLANK}]+\z", "")


def squeeze(c) -> Column:
    """Collapse blanks and trim; keeps case and punctuation."""
    return F.trim(F.regexp_replace(_col(c), rf"[{BLANK}]+", " "))


def strip_prefix(c) -> Column:
    return F.regexp_replace(_col(c), BODY_PREFIX, "")


def keep_runs(c, kept: str) -> Column:
    """Lower-case runs of the kept characters, joined by single spaces.

    Same result as blanking all other characters, collapsing and trimming, in
    one scan; scanning for kept runs is several times faster than replacing.
    """
    return F.array_join(F.regexp_extract_all(F.lower(_col(c)), F.lit(f"[{kept}]+"), F.lit(0)), " ")


def clean_latin(c) -> Column:
    return keep_runs(c, LATIN_KEEP)


def clean_ascii(c) -> Column:
    return keep_runs(c, ASCII_KEEP)


def clean_spam(c) -> Column:
    # Digits are no letters, so keeping letters drops them too.
    return keep_runs(F.regexp_replace(F.lower(_col(c)), URL, " "), LETTER_KEEP)


def normalize_body(c) -> Column:
    text = F.coalesce(_col(c), F.lit(""))
    # A single blank stays as it is, so that most words need no replacement.
    text = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def last_blank(c: Column) -> Column:
    """0-based position of the last space, -1 when there is none."""
    back = F.instr(F.reverse(c), " ")
    return F.when(back > 0, F.length(c) - back).otherwise(F.lit(-1))


def truncate_words(c, n: int = domain.MAX_BODY_CHARS, marker: str = domain.BODY_MARKER) -> Column:
    """Cut to ``n`` characters, back to the last space when it lies beyond 80 % of ``n``."""
    def cut(head):
        return let(last_blank(head), lambda at: F.when(at > F.lit(0.8 * n), F.substring(head, F.lit(1), at)).otherwise(head))

    return let(_col(c), lambda text: F.when(
        F.length(text) > n, F.concat(let(F.substring(text, 1, n), cut), F.lit(marker))).otherwise(text))


def cut_at_blank(c: Column, n: Column) -> Column:
    """First ``n`` characters without the last, possibly broken word."""
    def cut(head):
        return let(last_blank(head), lambda at: F.when(at >= 0, F.substring(head, F.lit(1), at)).otherwise(head))

    return let(F.substring(c, F.lit(1), n), cut)


def shrink(c, level: int) -> Column:
    """Shorter variant 1 (half, at least 400), 2 (quarter, at least 200) or 3 (200 characters)."""
    text = _col(c)
    size = F.length(text)
    marker = F.lit(domain.SHRINK_MARKER)
    if level == 1:
        return F.concat(cut_at_blank(text, F.greatest(F.lit(400), F.floor(size / 2).cast("int"))), marker)
    if level == 2:
        return F.concat(cut_at_blank(text, F.greatest(F.lit(200), F.floor(size / 4).cast("int"))), marker)
    return F.when(size > 200, F.concat(cut_at_blank(text, F.lit(200)), marker)).otherwise(text)


def tokens(c) -> Column:
    """Tokens between blanks."""
    return F.filter(F.split(_col(c), rf"[{BLANK}]+"), lambda t: t != "")


def word_tokens(c) -> Column:
    """Lower-case runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD), F.lit(0))


def fingerprint(c) -> Column:
    return F.md5(_col(c))


def cache_key(strategy: str, partition: str, row_id, text, model: str) -> Column:
    row = F.coalesce(F.when(_col(row_id).cast("string") != "", _col(row_id).cast("string")), F.lit("noid"))
    return F.md5(F.concat_ws("|", F.lit(strategy), F.lit(partition), row, F.md5(_col(text)), F.lit(model)))


def compose_text(subject, body, with_subject: bool) -> Column:
    body = F.coalesce(_col(body), F.lit(""))
    if not with_subject:
        return body
    return F.concat(F.coalesce(_col(subject), F.lit("")), F.lit(" "), body)


def lookup(key, mapping: dict[str, str], default: str | None = None) -> Column:
    """Literal dictionary lookup with a default."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.element_at(table, _col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def placeholders(*cols) -> Column:
    """Sorted distinct ``[...]`` tokens of 2 to 40 characters."""
    text = F.concat_ws(" ", *[_col(c) for c in cols])
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))))


def looks_truncated(c) -> Column:
    text = _col(c)
    return (text != "") & ~text.rlike(SENTENCE_END)


def json_block(c) -> Column:
    """Largest ``{...}`` span; empty when there is none."""
    return F.regexp_extract(_col(c), r"(?s)\{.*\}", 0)


def strip_reasoning(c) -> Column:
    """Text after the reasoning blocks; null when a channel block is never closed."""
    text = _col(c)
    close = "<channel|>"
    opened = text.contains("<|channel>thought")
    after = strip(F.substring_index(text, close, -1))
    text = F.when(~opened, text).when(text.contains(close), after)
    return strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
