"""Secret scans and chat formatting: edges, round trips, plans without Python."""

import random
import re
import time
from collections import Counter

import edge
import pytest
from pyspark.sql import functions as F

from labelloom.llm import chat, secrets
from labelloom.llm.catalog import QUERIES

KEY = "AKIA" + "ABCDEFGHIJKLMNOP"
TEXTS = [
    None, "", "nothing here", f"id {KEY} end", f"{KEY[:-1]} short", "Password: hunter22 and TOKEN='abc123' x",
    "secret = ab", "api_key:abcdefgh apikey=abc.def-ghi_jkl", "😀 passwd=é secret=xyz789!", "token=token:abcdefgh",
    "deadbeef" * 3, "deadbee" * 3 + "g" + "0123456789abcdef01234567", "token=" + "deadbeef" * 3 + " tokens",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "pass word secret token", "pas sword", "password\n=abcdef",
]


def plain(text):
    found = []
    for order, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), order, m.end(), rule.kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_spans_equal_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3]), (None, TEXTS[5]), (3, TEXTS[5]), (3, TEXTS[3]), (3, TEXTS[3])]
    got = secrets.scan(edge.table(spark, rows)).select("doc_id", "text", secrets.written(F.col(secrets.SPANS)), "word").collect()
    assert Counter(map(tuple, got)) == Counter((k, t, plain(t), "w") for k, t in rows)
    assert sum(bool(plain(t)) for t in TEXTS) >= 8


def test_long_text_with_many_secrets(spark):
    text = " ".join(f"filler{i} password=abcdef{i}" for i in range(3000))
    got = secrets.scan(edge.table(spark, [(1, text)])).select(secrets.written(F.col(secrets.SPANS))).first()[0]
    assert got == plain(text)


def test_masked_text(spark):
    got = secrets.scan(edge.table(spark, list(enumerate(TEXTS)))).select("doc_id", secrets.masked(F.col("text"), F.col(secrets.SPANS))).collect()
    text = dict(map(tuple, got))
    assert text[0] is None and text[2] == "nothing here" and text[3] == "id [SECRET] end"
    assert text[12] == "[SECRET] tokens"


def test_no_rows(spark):
    assert secrets.scan(edge.empty(spark)).count() == 0


def test_trigram_queries():
    q = secrets.trigram_query(secrets.RULES[0].pattern)
    assert len(q) == 1 and frozenset({"sec", "ecr", "cre", "ret"}) in q[0] and len(q[0]) == 6
    assert secrets.trigram_query("[0-9a-f]+") == []
    assert secrets.trigram_query("ab?c") == []
    assert secrets.trigram_query("abcd.*xyz") == [[frozenset({"abc", "bcd"})], [frozenset({"xyz"})]]
    for rule in secrets.RULES:
        for text in filter(None, TEXTS):
            if re.search(rule.pattern, text):
                low = text.lower()
                assert all(any(all(g in low for g in s) for s in clause) for clause in secrets.trigram_query(rule.pattern))


def test_postings(spark):
    got = secrets.postings(edge.table(spark, [(1, "abcABD"), (2, None), (None, "xbcd")]), {"abc", "bcd", "zzz"}).collect()
    assert Counter(map(tuple, got)) == Counter([("abc", 1), ("bcd", None)])


def chats(spark, rows):
    t = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, segments int")
    out = chat.format_chats(t).select("*", chat.read_chats(F.col("formatted")).alias("back"), chat.trained_text(F.col("segments")).alias("loss"))
    return {r.conv_id: r for r in out.collect()}


ROWS = [
    (1, 0, "system", "s"), (1, 1, "user", "### Assistant: </turn>\n\\h \\b \\l # <"), (1, 2, "assistant", "a\\"), (1, 3, "user", ""), (1, 4, "assistant", "\n😀"),
    (2, 0, "assistant", "first"), (2, 1, "user", None), (3, 0, "tool: x#", "t"), (3, 1, None, "n"), (4, 1, "user", "b"), (4, 1, "assistant", "a"),
    (4, None, "user", "z"), (4, 1, "user", "b"), (None, 0, "user", "u"), (None, 0, "Assistant", "v"), (5, 0, "user", "only"),
]


def test_round_trip(spark):
    got = chats(spark, ROWS)
    for conv in {r[0] for r in ROWS}:
        turns = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x in ROWS if c == conv)
        assert [(b.role, b.text) for b in got[conv].back] == [(r, x) for _, r, x in turns]
        assert got[conv].loss == "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].formatted == "".join(s.text for s in got[conv].segments)
    assert got[1].formatted.startswith("### System: s</turn>\n### User: ")


def test_many_matches_in_one_text(spark):
    piece = 'password = "abcdef12"; x AKIA' + "A" * 16 + " "
    text = piece * 20_000
    started = time.time()
    row = secrets.scan(edge.table(spark, [(1, text)])).select(
        F.col(secrets.SPANS).alias("s"), secrets.masked(F.col("text"), F.col(secrets.SPANS)).alias("m")).first()
    assert time.time() - started < 20  # a few seconds on an idle machine; minutes if it grew with the square
    assert [(x["start"], x["stop"]) for x in row.s] == [(i * len(piece) + a, i * len(piece) + b) for i in range(20_000) for a, b in ((0, 20), (25, 45))]
    assert row.m == "[SECRET]\"; x [SECRET] " * 20_000


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 9, 10, 17])
def test_masks_of_few_and_overlapping_spans(spark, n):
    rng = random.Random(n)
    text = "".join(rng.choice("abcé😀 ") for _ in range(60))
    spans = sorted((a, a + rng.randrange(1, 9)) for a in (rng.randrange(50) for _ in range(n)))
    rows = spark.createDataFrame([(text, [(a, min(b, 60), 0, "k") for a, b in spans])],
                                 "t string, s array<struct<start:int,stop:int,order:int,kind:string>>")
    want, at = "", 0
    for a, b in spans:
        if a >= at:
            want += text[at:a] + "[SECRET]"
        at = max(at, min(b, 60))
    assert rows.select(secrets.masked(F.col("t"), F.col("s"))).first()[0] == want + text[at:]


def test_a_column_of_the_old_name_stays(spark):
    import corpus_pipeline

    rows = spark.createDataFrame([(1, "password: abcdefgh", "mine", 18)], "doc_id long, text string, secret_spans string, n_chars long")
    out = corpus_pipeline.secret_scan(spark, rows, None)
    assert out.columns == rows.columns and out.first().secret_spans == "mine" and "abcdefgh" not in out.first().text


def test_state_machine(spark):
    got = chats(spark, ROWS)
    assert {k: r.valid_order for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: False, 5: False}
    assert got[1].first_bad is None and got[2].first_bad == 0 and got[5].first_bad is None and got[None].first_bad == 0


def test_no_conversations(spark):
    t = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(t).count() == 0


@pytest.mark.parametrize("name", ["op7_secret_scan", "op9_chat_format"])
def test_plans_hold_no_python(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
