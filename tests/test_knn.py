"""Exact neighbours against numpy, whatever the blocks, pivots, copies and exclusions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import knn as nn


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(300):
        # A third of the rows are copies of one vector.
        v = centres[0] if i % 3 == 0 else centres[i % 6] + 0.2 * rng.normal(size=8)
        rows.append((i, [float(x) for x in v], i % 4, i % 5))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, fold int").cache()
    return df, rows


def brute(rows, k, exclude):
    m = np.asarray([r[1] for r in rows], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    dist = np.round(1 - m @ m.T, 9) + 0.0
    out = set()
    for i, r in enumerate(rows):
        ok = [j for j, o in enumerate(rows) if not (exclude == "id" and j == i) and not (exclude == "group" and o[3] == r[3])]
        for rank, j in enumerate(sorted(ok, key=lambda j: (dist[i, j], rows[j][0]))[:k], 1):
            out.add((r[0], rank, rows[j][0]))
    return out


@pytest.mark.parametrize("exclude", [None, "id", "group"])
@pytest.mark.parametrize("options", [
    {}, {"small_bytes": 0}, {"small_bytes": 0, "block_rows": 40, "query_rows": 50}, {"n_pivots": 12, "block_rows": 30, "query_rows": 30}, {"n_pivots": 40},
])
def test_equals_brute_force(vectors, exclude, options):
    df, rows = vectors
    groups = {"qgroup": "fold", "bgroup": "fold"} if exclude == "group" else {}
    got = nn.knn(df, df, 5, payload="label", exclude=exclude, **groups, **options)
    assert {(r.query_id, r.rank, r.base_id) for r in got.collect()} == brute(rows, 5, exclude)


@pytest.mark.parametrize("small_bytes", [0, 1 << 20])
def test_few_queries_and_null_vectors(spark, vectors, small_bytes):
    df, rows = vectors
    few = df.where("vec_id < 7").select("vec_id", "embedding")
    none = spark.createDataFrame([(999, None)], "vec_id long, embedding array<float>")
    store = df.unionByName(none, allowMissingColumns=True)
    got = nn.knn(few.unionByName(none), store, 5, payload="label", small_bytes=small_bytes)
    want = {x for x in brute(rows, 5, None) if x[0] < 7}
    assert {(r.query_id, r.rank, r.base_id) for r in got.collect()} == want


def test_k_larger_than_base(vectors):
    df, rows = vectors
    got = nn.knn(df.where("vec_id < 4"), df.where("vec_id < 4"), 10, exclude="id")
    assert got.count() == 12


def test_self_is_nearest(vectors):
    df, _ = vectors
    first = nn.knn(df, df, 1, n_pivots=8).collect()
    assert len(first) == 300 and all(abs(r.distance) < 1e-9 for r in first)


def test_vote_tie_goes_to_nearest(spark):
    near = spark.createDataFrame([(1, i + 1, l) for i, l in enumerate("ABBAC")], "query_id long, rank int, payload string")
    row = nn.knn_vote(near).first()
    assert (row.pred_label, row.votes) == ("A", 2)


def test_scores_sum_to_one(spark):
    near = spark.createDataFrame([(1, i + 1, l) for i, l in enumerate("ABBAC")], "query_id long, rank int, payload string")
    got = {r.label: r.score for r in nn.knn_scores(near, list("ABCD")).collect()}
    assert got["A"] == pytest.approx(3 / 9) and got["D"] == pytest.approx(1 / 9)
    assert sum(got.values()) == pytest.approx(1)


def test_bootstrap_widens_short_lists(spark, vectors):
    """A one-neighbour start list has to grow until five drawn copies are found."""
    from labelloom.operators.split import bootstrap, bootstrap_sizes

    df, _ = vectors
    boot = bootstrap(df, "vec_id", 2)
    short = nn.knn_bootstrap(df, boot, 5, "label", start=1)
    long = nn.knn_bootstrap(df, boot, 5, "label", start=299)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(short) == key(long)
    assert short.agg(F.sum("n")).first()[0] == bootstrap_sizes(boot).agg(F.sum("n_oob")).first()[0]


def test_bootstrap_votes_equal_a_loop():
    rng = np.random.default_rng(7)
    for _ in range(200):
        m, its, k = int(rng.integers(1, 12)), 6, int(rng.integers(1, 6))
        labels = rng.choice(list("abc"), m).tolist()
        drawn, own = rng.poisson(0.8, (m, its)), rng.poisson(0.7, its)
        best, few = nn.bootstrap_votes(labels, drawn, own, k)
        names = list(dict.fromkeys(labels))
        for i in range(its):
            copies = [l for l, n in zip(labels, drawn[:, i]) for _ in range(n)][:k]
            want = max(names, key=lambda l: (copies.count(l), -copies.index(l) if l in copies else -99)) if copies and not own[i] else None
            assert (names[best[i]] if best[i] >= 0 else None) == want
            assert few[i] == (own[i] == 0 and len(copies) < k)


@pytest.mark.parametrize("exclude", [None, "id", "group"])
def test_slices_of_a_block_equal_brute_force(vectors, monkeypatch, exclude):
    """The bound of the first slice loses no neighbour of the others, copies included."""
    import pyarrow as pa

    _, rows = vectors
    monkeypatch.setattr(nn, "SLICE", 16)
    out = pa.schema([("query_id", pa.int64()), ("base_id", pa.int64()), ("payload", pa.int32()), ("distance", pa.float64())])
    ids, vecs, folds = pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array([r[3] for r in rows])
    labels = pa.array([r[2] for r in rows], pa.int32())
    got = nn._compare(3, exclude, out)(
        pa.table([ids, vecs, folds], ["qid", "qvec", "qgroup"]), pa.table([ids, vecs, folds, labels], ["bid", "bvec", "bgroup", "payload"]))
    assert {(r["query_id"], r["base_id"]) for r in got.to_pylist()} == {(q, b) for q, _, b in brute(rows, 3, exclude)}


def test_blocks_do_not_multiply_with_the_rows():
    """What travels, rows times blocks, grows with the input while the blocks fit; small wished blocks change nothing."""
    for n in (10**5, 10**6, 10**7):
        for block in (64, 8192):
            nb, nq = nn._grid(48, n, n, 8.0, 8.0, 5, block, block)
            assert nb * nq <= 64 * max(1, n * 8 / nn.BLOCK_BYTES) ** 2
    nb, nq = nn._grid(48, 10**8, 10**8, 512.0, 512.0, 5, 8192, 8192)
    assert 10**8 / nb * 512 <= nn.BLOCK_BYTES and 10**8 / nq * 512 <= nn.BLOCK_BYTES
