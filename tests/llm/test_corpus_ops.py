"""Substring dedup, importance resampling and centroid clustering against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import edge
import numpy as np
import pytest

from labelloom.llm import centroids, resampling, substrings

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = {i: i + 32 for i in range(65, 91)}


def without_windows(pairs, width=35):
    """(id, words, kept words, spans) by a table of all windows."""
    words = [BLANKS.findall(t or "") for _, t in pairs]
    seen = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (key, _), w in zip(pairs, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        spans, i = [], 0
        while i < len(w):
            j = i
            while j < len(w) and j in gone:
                j += 1
            spans += [(i, j)] if j > i else []
            i = max(j, i + 1)
        out.append((key, len(w), " ".join(x for i, x in enumerate(w) if i not in gone), tuple(spans)))
    return Counter(out)


def spark_windows(spark, pairs, kind="long"):
    rows = spark.createDataFrame([(k, t, "x", 1) for k, t in pairs], f"doc_id {kind}, text string, words string, chunk int")
    got = substrings.remove_repeats(rows).collect()
    return Counter((r["id"], r["n_words"], r["kept"], tuple((s["start"], s["stop"]) for s in r["spans"])) for r in got)


def test_windows_of_awkward_rows(spark):
    pairs = edge.rows()
    assert spark_windows(spark, pairs) == without_windows(pairs)


def test_windows_with_branches_loops_and_hot_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    base = [word() for _ in range(300)]
    hot = [word() for _ in range(60)]
    pairs = []
    for i in range(120):  # copies that part and meet again at different words
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(300)] = word()
        pairs.append((i, " ".join(w[rng.randrange(80):rng.randrange(120, 300)])))
    for i in range(200):  # one passage in a third of the documents, at other places
        own = [word() for _ in range(rng.randrange(40))]
        pairs.append((1000 + i, " ".join(own + hot + [word() for _ in range(rng.randrange(40))])))
    pairs += [(3000 + n, "a b " * n) for n in (17, 18, 30, 100)] + [(4000 + n, "loop " * n) for n in (34, 35, 36, 200)]
    pairs += [(5000, " ".join(hot[:35])), (5001, " ".join(hot[:34])), (5002, "\t\n".join(hot[10:50]))]
    assert spark_windows(spark, pairs) == without_windows(pairs)


def test_windows_across_many_chunks(spark, monkeypatch):
    pairs = [(k, t) for s in range(5) for k, t in edge.rows(s % 3)]
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substrings, "PART_BYTES", 2000)
    assert spark_windows(spark, pairs) == without_windows(pairs)


def test_windows_with_ids_of_other_types(spark):
    pairs = [(f"k{k}", t) for k, t in edge.rows()]
    assert spark_windows(spark, pairs, "string") == without_windows(pairs)


def test_windows_of_nothing(spark):
    assert substrings.remove_repeats(edge.empty(spark)).count() == 0


def test_edges_that_only_a_hash_equates_stay(spark, monkeypatch):
    """With hashes of few values most edges collide; the words at the source coordinates decide."""
    real = substrings.mix
    monkeypatch.setattr(substrings, "mix", lambda h: real(h) & np.uint64(0xFF00000000000000))
    rng = random.Random(2)
    pairs = [(i, edge.sentence(rng, 60)) for i in range(20)]
    table = spark.createDataFrame(pairs, "doc_id long, text string")
    assert all(r["spans"] == [] for r in substrings.remove_repeats(table).collect())


def test_crc_of_all_lengths():
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 2, 3, 3, 3, 200, 7, 7, 5000]]
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    start = np.cumsum(size) - size
    want = [zlib.crc32(p) for p in parts]
    assert resampling.crc_spans(data, start, size).tolist() == want
    assert resampling.crc_spans(data, start, size, cells=8).tolist() == want


def grams(text):
    w = TERMS.findall((text or "").translate(LOWERED))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def by_hand(pairs, target):
    n = resampling.BUCKETS
    bucket = lambda g: zlib.crc32(g.encode()) % n
    s, t = Counter(), Counter()
    for _, text in pairs:
        s.update(map(bucket, grams(text)[1]))
    for text in target:
        t.update(map(bucket, grams(text)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for key, text in pairs:
        words, g = grams(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + n) / ((s[b] + 1) * (big_t + n)))) for b in map(bucket, g)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((key, len(g), weight, score, words))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    draw = 25 * len(able) // 100
    ranked = Counter((*r[:4], i + 1 if i < draw else None) for i, r in enumerate(able))
    return ranked + Counter((*r[:4], None) for r in rows if r[4] < 20)


def drawn(spark, pairs, target):
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(edge.table(spark, pairs), goal)
    return Counter(tuple(r) for r in got.select("id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("target", [["one two words", None, "The ab cd ef gh, ij!"], []])
def test_resampling_of_awkward_rows(spark, target):
    pairs = edge.rows() + [(100 + k, t) for k, t in edge.rows(5) if k is not None] + [(900, "É é Éa 0-9_z\x00y [a] {b}")]
    assert drawn(spark, pairs, target) == by_hand(pairs, target)


def test_resampling_of_nothing(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(edge.empty(spark), target).count() == 0


def test_resampling_draws_what_looks_like_the_target(spark):
    rng = random.Random(8)
    pairs = [(i, " ".join(rng.choice(["gold", "silver", "coin"] if i % 4 == 0 else ["mud", "sand", "clay"]) for _ in range(30))) for i in range(400)]
    goal = spark.createDataFrame([("gold coin silver gold",)] * 50, "text string")
    got = resampling.resample(spark.createDataFrame(pairs, "doc_id long, text string"), goal).where("rank is not null").collect()
    assert len(got) == 100 and sum(r["id"] % 4 == 0 for r in got) >= 80


def lloyd(rows, k=16, rounds=3, dims=64):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(64 * x) for x in v]))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else m for j, m in enumerate(c)]
    last = [(key, *nearest(v)[::-1]) for key, v in kept]
    per = Counter()
    for _, j, far in last:
        per[j] += far
    return Counter((key, j, far, per[j], sum(per.values()), tuple(c[j])) for key, j, far in last)


def awkward_vectors(n=300):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    return rows + [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [1.0] * 63), (2004, [math.nan] + [0.0] * 63),
                   (2005, [math.inf] + [0.0] * 63), (2006, [None] + [0.0] * 63), (2007, [-0.001] * 64)]


def clusters(spark, rows):
    table = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id long, embedding array<double>, cluster int, block int")
    return Counter((r["id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"]))
                   for r in centroids.cluster(table).collect())


def test_clusters_of_awkward_vectors(spark):
    rows = awkward_vectors()
    assert clusters(spark, rows) == lloyd(rows)


def test_clusters_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(centroids, "ROWS", 7)
    monkeypatch.setattr(centroids, "WIDTH", 20)  # the last shard is narrower
    rows = awkward_vectors(90)
    assert clusters(spark, rows) == lloyd(rows)


def test_clusters_of_few_and_no_vectors(spark):
    few = awkward_vectors()[:5]
    assert clusters(spark, few) == lloyd(few)
    assert clusters(spark, [(1, None), (2, [1.0])]) == Counter()
    assert clusters(spark, [(i, [0.5] * 64) for i in range(40)]) == lloyd([(i, [0.5] * 64) for i in range(40)])


def test_centroid_slices_cover_all_columns(spark):
    rows = spark.createDataFrame([(1, list(range(40)))], "id long, v array<bigint>")
    parts = centroids._blocks(rows, 40).orderBy("shard").collect()
    assert [len(r["part"]) // 8 for r in parts] == [16, 16, 8] and [len(r["ids"]) for r in parts] == [1, 0, 0]
