"""Text, draft and answer functions on hand-made edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from labelloom import domain
from labelloom.operators import profile as pf
from labelloom.functions import answers as an
from labelloom.functions import text as tx
from labelloom.operators.drafts import extract_mail
from labelloom.operators.prepare import drop_blank, drop_missing


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn("c").alias("o")).first()["o"]


@pytest.mark.parametrize("fn, given, want", [
    (tx.clean_latin, "  Ñandú,  ÁRBOL  n.º 3\t", "ñandú árbol n 3"),
    (tx.clean_ascii, "Ñandú-42!", "and 42"),
    (tx.clean_spam, "Ver http://a.b/c?d=1 y www.x.es: 24 EUROS", "ver y euros"),
    (tx.squeeze, " A \n\t b ", "A b"),
    (tx.strip_prefix, "BODY:  \n hola BODY: x", "hola BODY: x"),
    (tx.normalize_body, " a \t b\n\n\n\nc \n", "a b\n\nc"),
    (tx.normalize_body, None, ""),
    (tx.clean_latin, "", ""),
])
def test_cleaning(spark, fn, given, want):
    assert one(spark, given, fn) == want


def test_truncate_words(spark):
    assert one(spark, "aaaa bbbb cc", lambda c: tx.truncate_words(c, 10, "~")) == "aaaa bbbb~"
    # The space at index 4 lies below 80 % of 9, so the cut stays where it is.
    assert one(spark, "aaaa bbbbbbbb", lambda c: tx.truncate_words(c, 9, "~")) == "aaaa bbbb~"
    assert one(spark, "short", lambda c: tx.truncate_words(c, 9, "~")) == "short"


def test_shrink_levels(spark):
    text = "palabra " * 200
    half, quarter, least = (one(spark, text, lambda c, i=i: tx.shrink(c, i)) for i in (1, 2, 3))
    assert len(half) == 799 + len(" [TRUNCADO]") and len(quarter) == 399 + len(" [TRUNCADO]")
    assert least == ("palabra " * 25).strip() + " [TRUNCADO]"
    assert one(spark, "uno dos", lambda c: tx.shrink(c, 1)) == "uno [TRUNCADO]"
    assert one(spark, "uno dos", lambda c: tx.shrink(c, 3)) == "uno dos"


def test_tokens(spark):
    assert one(spark, "Un é día_1 x 22", tx.word_tokens) == ["un", "día_1", "22"]
    assert one(spark, "  a  b c ", tx.tokens) == ["a", "b", "c"]


def test_blank_and_missing_rows(spark):
    rows = spark.createDataFrame([("", "a"), ("  ", "a"), (None, "a"), (" x ", None), (" x ", " b ")], "text string, label string")
    assert [tuple(r) for r in drop_blank(drop_missing(rows)).collect()] == [("x", "b")]


@pytest.mark.parametrize("raw, want", [
    ("reclamacion", "reclamacion_factura"),
    ("  Bono Social ", "bono_social"),
    ("categoria: fuga_gas", "fuga_gas"),
    ("consulta-lectura-del-contador", "consulta_lectura_contador"),
    ("zzz", None),
    ("", None),
])
def test_resolve_label(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "c string")
    assert an.resolve_labels(df, "c").first()["label"] == want


@pytest.mark.parametrize("raw, label, conf, error, retry", [
    ('{"predicted_label": "fuga_gas", "confidence": "0.8"}', "fuga_gas", 0.8, False, False),
    ('{"predicted_label": "fuga_gas", "confidence": true}', "fuga_gas", 1.0, False, False),
    ('{"predicted_label": "fuga_gas", "confidence": null}', "fuga_gas", 0.5, False, False),
    ('{"predicted_label": "fuga_gas", "confidence": "n/a"}', "fuga_gas", 0.5, False, False),
    ('{"predicted_label": "fuga_gas", "confidence": 1.7}', "fuga_gas", 1.0, False, False),
    ('{"predicted_label": "fuga_gas"}', "fuga_gas", 0.0, False, False),
    ('{"predicted_label": "newsletter", "confidence": -3,}', "newsletter", 0.0, False, False),
    ('x {"predicted_label": "fuga_gas", "confidence": 0.', "otro_irrelevante", 0.0, True, True),
    ('x {"predicted_label": "fuga_gas", "confidence": }', "fuga_gas", 0.0, True, False),
    ('{"predicted_label": null, "confidence": 1}', "otro_irrelevante", 0.0, True, False),
    ('{"a": 1} and {"b": 2}', "otro_irrelevante", 0.0, True, True),
    ("", "otro_irrelevante", 0.0, True, True),
    (None, "otro_irrelevante", 0.0, True, True),
])
def test_parse_answer(spark, raw, label, conf, error, retry):
    out = an.parse_answer(spark.createDataFrame([(raw,)], "raw_response string")).first()
    if error and label != "otro_irrelevante":
        assert out["class_scores"][label] == 1.0
    assert (out.predicted_label, out.confidence, out.parse_error, out.needs_retry) == (label, conf, error, retry)
    assert sorted(out["class_scores"]) == sorted(domain.LABELS)
    assert sum(out["class_scores"].values()) == pytest.approx(1)


def test_last_of_equal_keys_counts(spark):
    raw = '{"predicted_label": "a", "predicted_label": "b", "class_scores": {"a": 1, "b": 2, "a": 6}}'
    out = an.parse_answer(spark.createDataFrame([(raw,)], "raw_response string"), labels=["a", "b"], aliases={}, fallback="a").first()
    assert out.predicted_label == "b" and out["class_scores"] == {"a": 0.75, "b": 0.25}


def test_all_zero_scores_become_uniform(spark):
    out = spark.range(1).select(an.normalize_scores(F.create_map(F.lit("a"), F.lit(0.0), F.lit("b"), F.lit(0.0))).alias("m")).first()
    assert out["m"] == {"a": 0.5, "b": 0.5}


@pytest.mark.parametrize("raw, want", [
    ('"Alta"', "Alta"), ("baja\nporque si", "Baja"), ("creo que es alta nueva", "Alta nueva"),
    ("bajaa", "Baja"), ("xyz", "Alta"), (None, "Alta"), ("", "Alta"), ("nueva cosa", "Alta nueva"),
])
def test_resolve_closed(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "c string")
    assert an.resolve_closed(df, "c", ["Alta", "Baja", "Alta nueva"]).first()["label"] == want


@pytest.mark.parametrize("raw, status, subject, body", [
    ("", "empty", "[Sin asunto]", "[Generación fallida]"),
    (None, "empty", "[Sin asunto]", "[Generación fallida]"),
    ("<|channel>thought never closed", "open_reasoning", "[Sin asunto]", "[Generación fallida - tokens agotados en razonamiento]"),
    ("hola", "no_subject", "[Sin asunto]", "[Generación fallida - sin formato válido]"),
    ("SUBJECT: A\n---\nBODY: Hola.\n", "ok", "A", "Hola."),
    ("SUBJECT: x\nsubject: Corte\n----\nCorte\nHola.", "ok", "Corte", "Hola."),
    ("<think>SUBJECT: no</think>SUBJECT: si\n---\ntexto", "ok", "si", "texto"),
    ("SUBJECT:\n---\nPrimera linea\nresto", "ok", "---", "Primera linea\nresto"),
])
def test_extract_mail(spark, raw, status, subject, body):
    out = extract_mail(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (out.status, out.subject, out.body) == (status, subject, body)


def test_placeholders_and_truncation(spark):
    raw = "SUBJECT: Para [Nombre]\n---\nHola [Nombre], su [DNI] y [x] sin final"
    out = extract_mail(spark.createDataFrame([(raw,)], "raw string")).first()
    assert out.placeholders == ["[DNI]", "[Nombre]"] and out.truncated


def test_pruned_similarity_gives_the_same_answers(spark):
    rng = random.Random(4)
    labels = ["solicitud_baja", "Alta nueva", "queja", "x", "otro irrelevante", "ñandú", "--"]
    cands = ["", "zzz", "quejas", "baja solicitud", "otro", "ALTA", "nueva_alta", "irrelevante", "ñandu", "qéuja", "a" * 300, "x_y", "-"]
    cands += ["".join(rng.choice("solicitudbajaquenñ _") for _ in range(rng.randrange(1, 18))) for _ in range(300)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cands)], "id int, c string")
    every = df.withColumn("__cand", F.col("c")).select("id", an.closed_similarity(labels)(F.trim("c")).alias("want"))
    rows = an.resolve_closed(df, "c", labels, compared="asked").join(every, "id").collect()
    low = [l.lower() for l in labels]
    asked = [r for r in rows if r.asked]
    for r in rows:
        told = r.c.strip()
        if r.asked or not any(l in told.lower() for l in low):
            assert r.label == r.want, r
    assert 0 < len(asked) < len(rows) / 2


def test_ordered_digest(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(None, "a"), (None, None), (5, "again")]
    digest = lambda pairs, n=1: pf.ordered_digest(spark.createDataFrame(pairs, "id long, t string").repartition(n), "id", "t").first()
    first = digest(rows)
    assert first.n == len(rows) and len(first.digest) == 16
    assert digest(rows[::-1], 7) == first
    swapped = list(rows)
    swapped[3], swapped[9] = (3, "text 9"), (9, "text 3")
    assert len({first.digest, digest(swapped).digest, digest(rows[:-1]).digest, digest([*rows, rows[0]]).digest}) == 4
    assert digest([]).n == 0


def test_bodies_equal_a_plain_loop(spark):
    """Runs of blanks and tabs, cuts at the last blank and texts without one, against Python."""
    import re

    from labelloom import domain
    from labelloom.functions import text as tx

    rows = ["", " ", "a\tb", "a \t b", "\t", "a  b\n\n\n\nc ", "x" * 50, "ab " * 20, "ab" * 14 + " " + "c" * 30, "word " + "y" * 60, None]

    def plain(t):
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t or "")).strip()
        if len(t) <= 30:
            return t
        at = t[:30].rfind(" ")
        return (t[:30][:at] if at > 24 else t[:30]) + domain.BODY_MARKER

    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, t string")
    got = {r.id: r.b for r in df.select("id", tx.truncate_words(tx.normalize_body("t"), 30).alias("b")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(rows)}


def test_the_body_is_cleaned_once_per_row(spark):
    """The cleaned text stands once in the plan, however long the cut's expression is."""
    from labelloom.functions import text as tx

    df = spark.createDataFrame([("a",)], "t string").select(tx.truncate_words(tx.normalize_body("t")).alias("b"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("{3,}") == 1
