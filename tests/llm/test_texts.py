"""Quality rules, toxicity, packing, byte BPE and the language model against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import edge
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelloom.llm import bpe, linear, lm, packing, quality, toxicity
from labelloom.llm.catalog import QUERIES

WORD = re.compile("[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen = text.split("\n"), set()
    dup = 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    n, r = len(words), len(inside)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, r, n < 20 or 100 * r > 30 * n)


def test_quality_counts_equal_plain_python(spark):
    rows = edge.rows()
    got = Counter(tuple(r)[:7] for r in quality.judge(edge.table(spark, rows), None).collect())
    assert got == Counter((k, *base_counts(t)) for k, t in rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x0b\x1f#é|", max_size=60), max_size=6))
def test_quality_counts_of_any_chunk(texts):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    base, _ = quality.counts(np.frombuffer(b"".join(raw), np.uint8), off)
    assert list(zip(*[base[c].tolist() for c in base])) == [base_counts(t) for t in texts]


def test_quality_score_does_not_depend_on_neighbours(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    one = {r.doc_id: r.probability for r in quality.judge(docs.limit(30), model).collect()}
    two = {r.doc_id: r.probability for r in quality.judge(docs.orderBy(F.desc("doc_id")), model).collect()}
    assert one and all(abs(two[k] - p) < 1e-9 for k, p in one.items())


def test_quality_on_rows_not_learned_from(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = quality.judge(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed").collect()
    right = sum(r.kept == (r.quality == 1) for r in got)
    assert len(got) > 60 and right > 0.93 * len(got)


def test_quality_without_labels_and_rows(spark):
    docs = edge.table(spark, edge.rows())
    none = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) is None
    assert quality.judge(edge.empty(spark), None).count() == 0
    kept = quality.keep(docs, None)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not base_counts(t)[5] for _, t in edge.rows())


def test_calibration_gives_the_share():
    rng = np.random.default_rng(1)
    y = (rng.random(2000) < 0.3).astype(float)
    z = y * 2 + rng.standard_normal(2000)
    a, b = linear.calibrate(z, y, np.ones(2000))
    p = 1 / (1 + np.exp(-(a * z + b)))
    assert abs(p.mean() - 0.3) < 0.03 and a > 0


def test_grams_are_the_distinct_hashed_ones():
    data = np.frombuffer("Abc aBC  xyz".encode(), np.uint8)
    low = b" abc abc  xyz "
    want = set()
    for n in toxicity.ORDERS:
        for i in range(len(low) - n + 1):
            g = int.from_bytes(low[i:i + n], "little") + (n << 56)
            want.add(((g * 0x9E3779B97F4A7C15) % 2**64) >> (64 - toxicity.BITS))
    got = toxicity.grams(data).tolist()
    assert len(got) == len(set(got)) and set(got) == want
    assert len(toxicity.grams(np.zeros(0, np.uint8))) == 0


def test_toxicity_held_out(spark):
    rows = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rows.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)


def test_toxicity_edges(spark):
    docs = edge.table(spark, edge.rows())
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in edge.rows())
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (30, 31, 32)}) == 1
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).collect()} == {0.0}
    assert toxicity.score(edge.empty(spark), (None, 0.0)).count() == 0


def check_pieces(rows, pieces, window=packing.WINDOW):
    tok = Tokenizer.from_file(packing.TOKENIZER)  # as it comes
    want = Counter((k, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for k, t in rows)
    by, seq, total = defaultdict(list), defaultdict(list), 0
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by[p.doc_id, p.doc_tokens].append(p)
        seq[p.sequence_id].append(p)
        total += p.length
    assert total == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    for (key, ids), n in want.items():
        # Copies of one row give the same ids at the same starts; every id lies in n pieces.
        depth = np.zeros(len(ids) // 4, int)
        for p in by[key, len(ids) // 4]:
            if ids[4 * p.start:4 * (p.start + p.length)] == bytes(p.ids):
                depth[p.start:p.start + p.length] += 1
        assert (depth >= n).all()
    padding = 0
    for parts in seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += window - at
    return padding, total


def test_packing_edges(spark):
    rows = edge.rows()
    got = packing.pack(edge.table(spark, rows)).collect()
    padding, _ = check_pieces(rows, got)
    assert padding < 8 * packing.WINDOW + 1
    assert packing.pack(edge.empty(spark)).count() == 0


def test_packing_takes_added_tokens_as_the_tokenizer_does(spark):
    rows = [(1, "hello <|startoftext|> a"), (2, "in<|endoftext|>side"), (3, "<|STARTOFTEXT|> Upper"), (4, "<|startoftext"), (5, "|> <| plain"),
            (6, "<|endoftext|><|startoftext|>"), (7, "two\n<|endoftext|>\tlines é")]
    got = packing.pack(edge.table(spark, rows)).collect()
    check_pieces(rows, got)
    assert 49406 in np.frombuffer(next(p.ids for p in got if p.doc_id == 1), "<u4")


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_labelled_fits_take_ids_of_any_type(spark, kind):
    rng = random.Random(3)
    rows = [(i, edge.sentence(rng, 30) + (" vile awful" if i % 3 == 0 else " nice fine")) for i in range(90)]
    make = str if kind == "string" else int
    docs = spark.createDataFrame([(make(k), t) for k, t in rows], f"doc_id {kind}, text string")
    labels = spark.createDataFrame([(make(k), int(k % 3 > 0), int(k % 3 == 0)) for k, _ in rows], f"doc_id {kind}, quality int, toxic int")
    judged = quality.judge(docs, quality.fit(docs, labels))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    assert judged.count() == scored.count() == 90 and judged.schema["doc_id"].dataType == scored.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    # The fit depends on the ids' text alone.
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    same = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    want = {str(r.doc_id): r.score for r in toxicity.score(plain, toxicity.fit(plain, same)).collect()}
    assert {str(r.doc_id): r.score for r in scored.collect()} == pytest.approx(want, abs=1e-6)


def test_packing_pads_one_window_per_task(spark):
    rows = [(i, edge.sentence(__import__("random").Random(i), 40 + i % 200)) for i in range(400)]
    got = packing.pack(edge.table(spark, rows).coalesce(1)).collect()
    padding, total = check_pieces(rows, got)
    assert padding < packing.WINDOW < total


def test_levels_pick_the_smallest_sum_of_squares():
    rng = np.random.default_rng(4)
    levels = packing.Levels(64)
    for _ in range(400):
        n = int(rng.integers(1, 64))
        costs = {}
        for h in range(0, 64 - n + 1):
            if h and not levels.counts[h]:
                continue
            after = levels.counts.copy()
            after[h] -= h > 0
            after[h + n] += h + n < 64
            costs[h] = int((after[1:64].astype(int) ** 2).sum())
        level = levels.choose(n)
        assert costs[level] == min(costs.values())
        levels.place((0, 0, b"\0" * 4 * n, n))
        assert sum(len(s) for s in levels.stacks.values()) == levels.open == levels.counts[1:64].sum()
    for _ in levels.settle():
        pass
    assert levels.open <= 1


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairs(cached=50)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab 'st\n\x1c\x85 é12!", max_size=200) | st.text(alphabet="aeinst", min_size=60, max_size=400))
def test_encoding_equals_the_library(coder, text):
    ids = np.frombuffer(coder.encode(text), np.int32).tolist()
    assert ids == library_once().encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def library_once(kept=[]):  # noqa: B006
    kept or kept.append(library())
    return kept[0]


def test_tree_of_a_long_match(coder):
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("etaoinshrdlué"), 30_000))
    assert np.frombuffer(coder.encode(text), np.int32).tolist() == library_once().encode_ordinary(text)
    assert coder.encode_piece(b"aaaaaaaa" * 200) == library_once().encode_ordinary("aaaaaaaa" * 200)


def test_bpe_edges(spark):
    rows = edge.rows()
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(edge.table(spark, rows))).collect())
    assert got == Counter((k, tuple(library_once().encode_ordinary(t or "")), (t or "").encode()) for k, t in rows)
    assert bpe.decode(bpe.encode(edge.empty(spark))).count() == 0


def test_bpe_query_digests(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op6_byte_bpe"](spark, sf).collect():
        ids = library_once().encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def check_lm(rows, got, frequent=None):
    words = [(k, WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [""]) for k, t in rows]
    counts = Counter(w for k, ws in words if lm.in_training(k) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for k, ws in words:
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)
        held = k is not None and zlib.crc32(str(k).encode()) % 7 == 2
        want[k, held, len(ws), sum(w in counts for w in ws), total, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 40])
def test_lm_base_equals_plain_python(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "VOCABULARY", 30)
    monkeypatch.setattr(lm, "CLASSES", 5)
    rows = edge.rows()
    docs = edge.table(spark, rows)
    model, counts = lm.fit(docs)
    check_lm(rows, lm.score(docs, model, counts).collect())


def test_lm_without_rows(spark):
    docs = edge.empty(spark)
    model, counts = lm.fit(docs)
    assert lm.score(docs, model, counts).count() == 0


def tiny_model(monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 12)
    monkeypatch.setattr(lm, "CLASSES", 4)
    frequent = {f"w{i}".encode(): 50 - i for i in range(20)} | {lm.END: 30}
    return lm.Model(frequent, sum(frequent.values()) + 9, len(frequent) + 9)


def test_lm_is_a_distribution(monkeypatch):
    m = tiny_model(monkeypatch)
    n = len(m.cls)
    rng = np.random.default_rng(0)
    state = rng.standard_normal((1, lm.HIDDEN)).astype(np.float32)
    p = np.exp(m.log_probs(np.repeat(state, n, axis=0), np.arange(n)))
    assert abs(p.sum() - 1) < 1e-4
    # Add-one shares of the unknown words, one of them never seen, add up to one.
    outside = [c for w, c in m.frequent.items() if w not in m.ids] + [1] * 9
    assert abs(sum(10 ** m.log10_unknown(c) for c in outside) + 10 ** m.log10_unknown(0) - 1) < 1e-9


def test_lm_state_is_carried(monkeypatch):
    m = tiny_model(monkeypatch)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, m.unknown + 1, n) for n in (1, 5, 200, 33, 77, 32, 64)]
    at_once = []
    for t in texts:
        x = np.concatenate([[m.start], t[:-1]])[:, None]
        states, _ = m.run(x, np.zeros((1, lm.HIDDEN), np.float32))
        at_once.append(m.log_probs(states[1:, 0], t).sum())
    for lanes in (1, 3, 50):
        assert np.allclose(m.score(texts, lanes), at_once, rtol=1e-4, atol=1e-3)


def test_lm_gradient(monkeypatch):
    m = tiny_model(monkeypatch)
    rng = np.random.default_rng(2)
    m.p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in m.p.items()}
    x, y = rng.integers(0, m.unknown, (6, 3)), rng.integers(0, m.unknown + 1, (6, 3))
    keep, state = np.ones((6, 3), bool), np.zeros((3, lm.HIDDEN))

    def loss():
        states, _ = m.run(x, state)
        return -m.log_probs(states[1:].reshape(-1, lm.HIDDEN).astype(np.float64), y.ravel()).mean()

    g, _ = m.gradients(x, y, keep, state)
    for k in m.p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, eps = m.p[k][i], 1e-3
        m.p[k][i] = old + eps
        up = loss()
        m.p[k][i] = old - eps
        down = loss()
        m.p[k][i] = old
        assert abs((up - down) / (2 * eps) - g[k][i]) < 2e-2 * max(0.05, abs(g[k][i]))


def test_lm_beats_its_base(spark):
    rows = QUERIES["op8_lm_score"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.98 * sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held)


def test_lm_learns_from_the_long_documents_too(spark, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 60)
    monkeypatch.setattr(lm, "TRAIN_TOKENS", 2_000)
    monkeypatch.setattr(lm, "TASK_TOKENS", 20_000, raising=False)
    rng = np.random.default_rng(8)
    # Short documents in any order of words, long ones in which each word names the next.
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 30, 8))) for i in range(420)]
    rows += [(i, " ".join(f"w{(i + k) % 30}" for k in range(1_500))) for i in range(420, 490)]
    docs = edge.table(spark, rows)
    model, counts = lm.fit(docs)
    held = [r for r in lm.score(docs, model, counts).collect() if r.held_out and r.n_tokens > 1_000]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)
    again, _ = lm.fit(docs.repartition(5))
    assert all(np.array_equal(model.p[k], again.p[k]) for k in model.p)


def test_lm_long_texts_do_not_run_on_in_thousands_of_windows():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 1_000, n).astype(np.uint16) for n in [32_000, *rng.integers(1, 200, 300), 1]]
    read, windows = [[] for _ in texts], 0
    for x, y, keep, fresh, owner, *_ in lm._windows(texts, 64, 32, 7):
        windows += 1
        for lane, k in enumerate(owner):
            ids, before = y[:, lane][keep[:, lane]], x[:, lane][keep[:, lane]]
            if len(ids):
                assert before[0] == (7 if fresh[lane] else read[k][-1]) and np.array_equal(before[1:], ids[:-1])
                read[k].extend(ids.tolist())
    assert all(np.array_equal(a, b) for a, b in zip(read, texts))
    assert windows < 300  # a thousand before windows reached further where few lanes are left
