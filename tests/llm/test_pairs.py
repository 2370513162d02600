"""Near duplicates of vectors and texts, components and suffix dedup against brute force."""

import math
import random
from collections import Counter, defaultdict

import edge
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from labelloom.llm import components, embeddings, simhash, suffixes


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chain_star_and_loops(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(1000, 1200)] + [(7, 7), (2, 1), (1, 2), (2, 1)]
    got = dict(components.components(spark.createDataFrame(pairs, "u long, v long")).collect())
    want = {i: 100 for i in range(100, 161)} | {i: 5 for i in range(1000, 1200)} | {5: 5, 1: 1, 2: 1}
    assert got == want


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_local_roots():
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    a, b = np.array(pairs).T
    assert components.local_roots(300, a, b).tolist() == roots(300, pairs)


def vectors():
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((20, 16))
    rows = [(i, (centre[i % 20] + rng.standard_normal(16) * 0.12).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(5)] + [(2000, [x * 3 for x in rows[1][1]]), (2001, (-np.array(rows[1][1])).tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [float("inf")] + [1.0] * 15),
             (3005, [None] + [1.0] * 15), (None, rows[0][1]), (3006, [1.0, 2.0]), (3007, [2.0, 4.0])]
    rows += [(7, rows[7][1]), (7, rows[9][1]), (4000, [1e-30 * x for x in rows[3][1]])]
    return rows


def check_vectors(spark, rows):
    table = spark.createDataFrame([(k, v, 1, 2, "x") for k, v in rows], "vec_id long, embedding array<double>, node long, copies long, vec string")
    got = sorted(map(tuple, embeddings.near_duplicates(table).collect()), key=str)
    live = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for a in range(len(live)):
        for b in range(a + 1, len(live)):
            x, y = (np.array(rows[live[i]][1]) for i in (a, b))
            if len(x) == len(y):
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
                    links.append((live[a], live[b]))
    n = Counter(i for p in links for i in p)
    root = roots(len(rows), links)
    least = defaultdict(lambda: 1 << 60)
    for i in live:
        least[root[i]] = min(least[root[i]], rows[i][0])
    want = []
    for i, (k, _) in enumerate(rows):
        c = least[root[i]] if i in set(live) else k
        want.append((k, n[i], c, k is not None and k == c))
    assert got == sorted(want, key=str)
    assert links


def test_vectors_equal_brute_force(spark):
    check_vectors(spark, vectors())


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    check_vectors(spark, vectors())


def test_no_vectors(spark):
    t = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(t).count() == 0
    t = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embeddings.near_duplicates(t).collect()] == [(1, 0, 1, True)]


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, radius=4):
    u = np.array(sorted(set(fps)), np.uint64)
    pairs = [(a, b) for a in range(len(u)) for b in range(a) if int(u[a] ^ u[b]).bit_count() <= radius]
    return u, pairs


def test_simhash_equals_brute_force(spark):
    rows = edge.rows()
    got = Counter(map(tuple, simhash.near_duplicates(edge.table(spark, rows)).collect()))
    fps = [plain_fingerprint(t) for _, t in rows]
    u, pairs = linked(fps)
    root = dict(zip(u.tolist(), roots(len(u), pairs)))
    least = defaultdict(lambda: None)
    for (k, _), f in zip(rows, fps):
        if k is not None:
            least[root[f]] = k if least[root[f]] is None else min(k, least[root[f]])
    assert got == Counter((k, f"{f:016x}", least[root[f]]) for (k, _), f in zip(rows, fps))


@pytest.mark.parametrize("per_bucket,per_pass", [(1 << 17, 1 << 22), (64, 4096)])
def test_fingerprint_links_equal_brute_force(spark, monkeypatch, per_bucket, per_pass):
    monkeypatch.setattr(simhash, "PER_BUCKET", per_bucket)
    monkeypatch.setattr(simhash, "PER_PASS", per_pass)
    monkeypatch.setattr(simhash, "prefix_bits", lambda n: 6)
    rng = random.Random(2)
    fps = set()
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(8):
            y = x
            for bit in rng.sample(range(64), rng.randrange(0, 7)):
                y ^= 1 << bit
            fps.add(y)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    u, pairs = linked(fps)
    at = {int(x): i for i, x in enumerate(u.view(np.int64))}
    assert all(int(np.uint64(a & (2**64 - 1)) ^ np.uint64(b & (2**64 - 1))) for a, b in links)
    assert roots(len(u), [(at[a], at[b]) for a, b in links]) == roots(len(u), pairs)


def test_one_document_of_a_group_stays(spark):
    rows = edge.rows()
    docs = edge.table(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    u, pairs = linked([plain_fingerprint(t) for _, t in rows])
    assert kept.count() == len(set(roots(len(u), pairs)))
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 10 not in ids and 12 not in ids and 30 in ids


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0
    assert simhash.keep_one(edge.empty(spark)).count() == 0


def cut(texts, length=suffixes.LENGTH):
    """Removed flags per text by counting every string."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        step = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                step[i] += 1
                step[i + length] -= 1
        out.append((t, np.cumsum(step[:-1]) > 0))
    return out


def check_suffixes(spark, rows, docs):
    got = Counter()
    for r in suffixes.remove_repeats(docs).collect():
        got[r.id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)] += 1
    want = Counter()
    for (k, _), (t, gone) in zip(rows, cut([t for _, t in rows])):
        step = np.diff(np.pad(gone, 1).astype(int))
        want[k, len(t), tuple(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())),
             np.frombuffer(t, np.uint8)[~gone].tobytes()] += 1
    assert got == want


def test_suffixes_equal_brute_force(spark):
    rows = edge.rows()
    check_suffixes(spark, rows, edge.table(spark, rows))


@pytest.mark.parametrize("hot", [suffixes.HOT_CORE, 3])
def test_suffixes_on_small_alphabets_and_edits(spark, monkeypatch, hot):
    # Few distinct bytes, near copies cut and joined anywhere, long texts in parts, and buckets that split tokens.
    monkeypatch.setattr(suffixes, "SEGMENT", 2000)
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", 50)
    monkeypatch.setattr(suffixes, "HOT_CORE", hot)
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab") for _ in range(900)) for _ in range(4)] + ["".join(rng.choice("abc ") for _ in range(7000))]
    rows = []
    for i in range(60):
        t = list(rng.choice(pool))
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        a, b = sorted(rng.sample(range(len(t)), 2))
        t = "".join(t)
        rows.append((i, t[a:b] + rng.choice(pool)[:rng.randrange(600)] if i % 2 else t))
    rows += [(100 + i, "m" * n) for i, n in enumerate((199, 200, 201, 500))]
    check_suffixes(spark, rows, edge.table(spark, rows))


@pytest.mark.parametrize("piece", [7, 4096])
def test_strings_of_hot_cores_are_added_up_in_the_task(spark, monkeypatch, piece):
    monkeypatch.setattr(suffixes, "HOT_CORE", 3)
    monkeypatch.setattr(suffixes, "HOT_PIECE", piece, raising=False)
    seen, real = {}, suffixes.materialize

    def written(df, name):
        out = real(df, name)
        seen[name] = out.count(), out
        return out

    monkeypatch.setattr(suffixes, "materialize", written)
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(600))
    rows = []
    for i in range(60):  # near copies, an edit each
        at = rng.randrange(600)
        rows.append((i, text[:at] + rng.choice("XYZ") + text[at + 1:]))
    check_suffixes(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    hot = seen["strings"][1].groupBy("core").agg(F.count("*").alias("n"), F.sum(F.length("string") - suffixes.LENGTH + 1).alias("k")).where("n > 3")
    if piece > 60:
        assert seen["hot-strings"][0] < 0.8 * hot.agg(F.sum("k")).first()[0]


def test_suffixes_of_very_many_null_ids(spark):
    rng = random.Random(6)
    words = [edge.sentence(rng, 6) for _ in range(400)]
    rows = [(None if i % 5 else 7, "".join(rng.sample(words, 9))[:rng.randrange(205, 330)]) for i in range(24_000)]
    shared = "".join(rng.sample(words, 9))[:230]
    rows += [(None, f"{i:09d}{shared}") for i in range(50)] + [(None, rows[3][1])] * 2
    check_suffixes(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_compare_strings_is_exact():
    rng = random.Random(8)
    text = [bytes(rng.choice(b"ab") for _ in range(260)) for _ in range(3)]
    core = bytes(rng.choice(b"cd") for _ in range(suffixes.CORE))
    strings, reach = [], []
    for _ in range(40):
        left, right = rng.choice(text), rng.choice(text)
        count = rng.randrange(1, suffixes.BLOCK + 1)
        r = rng.randrange(count - 1, suffixes.BLOCK)
        size = count - 1 + suffixes.LENGTH - r - suffixes.CORE
        strings.append(left[200 - r:200] + core + right[:size])
        reach.append(r)
    weight = np.array([1] * 39 + [2])
    flags = suffixes.compare_strings(np.zeros(40, np.uint64), strings, np.array(reach), weight)
    seen = Counter()
    for s, r, w in zip(strings, reach, weight):
        for i in range(len(s) - suffixes.LENGTH + 1):
            seen[r - i, s[i:i + suffixes.LENGTH]] += w
    for i, (s, r) in enumerate(zip(strings, reach)):
        want = {r - k for k in range(len(s) - suffixes.LENGTH + 1) if seen[r - k, s[k:k + suffixes.LENGTH]] > 1}
        assert set(np.flatnonzero(flags[i]).tolist()) == want


def test_multikey_order():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 9, 500), rng.integers(0, 9, 500)
    order = suffixes.multikey_order(a, b)
    assert list(zip(a[order], b[order])) == sorted(zip(a, b))


def test_texts_without_repeats_keep_their_columns(spark):
    rows = edge.rows()
    docs = edge.table(spark, rows)
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns
    by = Counter((r.doc_id, r.text, r.word) for r in out.collect())
    want = Counter((k, None if o is None else np.frombuffer(t, np.uint8)[~g].tobytes().decode("utf-8", "ignore"), "w")
                   for (k, o), (t, g) in zip(rows, cut([t for _, t in rows])))
    assert by == want
    assert suffixes.without_repeats(edge.empty(spark)).count() == 0
