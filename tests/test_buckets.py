"""The versioned table in key buckets, and scoring passes that keep what they have."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators import scoring as sc
from labelloom.sources.buckets import BucketTable
from labelloom.sources.sinks import wide_predictions
from labelloom.streaming import scoring as ss
from labelloom.streaming import series as sr

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def shown(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def table(spark, tmp_path, buckets=16, keys=("k",)):
    return BucketTable(spark, str(tmp_path / "t"), SCHEMA, list(keys), buckets)


def test_upsert_read_and_older_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.versions() == []
    t.upsert(rows(spark, [(i, "a") for i in range(100)]))
    t.upsert(rows(spark, [(5, "b"), (200, "c"), (None, "n")]))
    t.upsert(rows(spark, [(None, "m"), (None, "m")]))
    want = {i: "a" for i in range(100)} | {5: "b", 200: "c", None: "m"}
    assert dict(map(tuple, t.read().collect())) == want and t.read().count() == 102
    assert shown(t.read(0)) == shown(rows(spark, [(i, "a") for i in range(100)]))
    assert dict(map(tuple, t.read(1).collect()))[None] == "n"


def test_what_is_written_follows_the_update(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, [(i, "x" * 50) for i in range(5000)]))
    whole = files(t.path + "/data")
    t.upsert(rows(spark, [(7, "y")]))
    more = {f: n for f, n in files(t.path + "/data").items() if f not in whole}
    assert len({os.path.dirname(f) for f in more}) == 1 and sum(more.values()) < sum(whole.values()) / 8
    assert files(t.path + "/data").keys() >= whole.keys()  # readers of the version before keep their files
    before = files(t.path)
    t.upsert(rows(spark, []))
    assert {f for f in files(t.path) if f not in before and "/data/" in f} == set() and t.read().count() == 5000


def test_a_repeated_version_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, [(1, "a")]), 0)
    t.upsert(rows(spark, [(1, "b")]), 4)
    seen = files(t.path)
    t.upsert(rows(spark, [(1, "c"), (2, "c")]), 4)
    assert files(t.path) == seen and shown(t.read()) == [(1, "b")]


def test_a_version_without_manifest_is_not_there(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, [(1, "a"), (2, "a")]), 0)
    # A writer died after its data, or inside its manifest.
    rows(spark, [(1, "lost")]).withColumn("bucket", F.lit(3)).write.partitionBy("bucket").parquet(t.path + "/data/version=1")
    os.makedirs(t.path + "/manifest/version=1/_temporary")
    assert shown(t.read()) == [(1, "a"), (2, "a")] and t.versions() == [0]
    t.upsert(rows(spark, [(2, "b")]), 1)
    assert shown(t.read()) == [(1, "a"), (2, "b")] and t.versions() == [0, 1]


def test_largest_order_wins(spark, tmp_path):
    schema = T.StructType.fromDDL("id int, part string, v string, ver int")
    t = BucketTable(spark, str(tmp_path / "t"), schema, ["id", "part"], 4)
    t.upsert(spark.createDataFrame([(1, "p", "a", 0), (1, "q", "z", 0), (2, "p", "b", 0)], schema))
    t.upsert(spark.createDataFrame([(2, "p", "d", 2), (2, "p", "c", 1), (1, "p", "e", 1)], schema), order="ver")
    assert shown(t.read()) == [(1, "p", "e", 1), (1, "q", "z", 0), (2, "p", "d", 2)]


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    t = table(spark, tmp_path, buckets=4)
    t.upsert(rows(spark, [(i, "a") for i in range(50)]))
    for n in range(3):
        t.upsert(rows(spark, [(i, f"b{n}") for i in range(50)]))
    before, want = len(files(t.path + "/data")), shown(t.read())
    assert t.vacuum() > 0 and len(files(t.path + "/data")) < before
    assert shown(t.read()) == want and t.versions() == [3] and t.vacuum() == 0
    t.upsert(rows(spark, [(1, "z")]))
    assert dict(map(tuple, t.read().collect()))[1] == "z"


def test_streamed_batches_rewrite_their_buckets_only(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "t")
    start = rows(spark, [(i, "x" * 40) for i in range(3000)])
    sizes = []
    for n in range(2):
        rows(spark, [(n, "new")]).coalesce(1).write.mode("append").parquet(src)
        before = files(out)
        got = ss.foreach_merge(sr.read_stream(spark, src, SCHEMA), start, ["k"], out, buckets=16)
        sizes.append(sum(s for f, s in files(out + "/data").items() if f not in before))
    assert got.where("v = 'new'").count() == 2 and got.count() == 3000
    assert sizes[1] < sizes[0] / 6


def counting(path, stop_at=None):
    """Client that notes every call in a file; at a given text it ends the worker's task."""
    def build():
        def answer(prompt):
            if stop_at and stop_at in prompt and not os.path.exists(f"{path}.stopped"):
                open(f"{path}.stopped", "w").close()
                raise SystemExit("client went away")
            with open(path, "a") as f:
                f.write("x\n")
            return '{"predicted_label": "a", "confidence": 0.9}' if "odd" not in prompt else "no json"

        return answer

    return build


def calls(path):
    return sum(1 for _ in open(path))


def ask(spark, docs, store, client):
    return sc.classify_answers(docs, "id", "text", client, ["a", "b"], {}, "b", "{labels} {text}", passes=2, store=store, chunk=10)


def test_a_killed_pass_goes_on_where_it_was(spark, tmp_path):
    # One file of answers at a time, so that it is known how much can be lost.
    docs = spark.createDataFrame([(i, f"text number {i} of all") for i in range(200)], "id long, text string").coalesce(1).sortWithinPartitions("id")
    store, log = str(tmp_path / "store"), str(tmp_path / "calls")
    with pytest.raises(Exception):
        ask(spark, docs, store, counting(log, "number 150 of"))
    first = calls(log)
    kept = spark.read.parquet(f"{store}/pass-1/answers").count()
    assert 0 < kept <= first < 200
    got = ask(spark, docs, store, counting(log))
    assert got.count() == 200 and got.where("predicted_label = 'a' and attempts = 1").count() == 200
    assert calls(log) - first == 200 - kept  # only what had no answer was asked again
    total = calls(log)
    assert ask(spark, docs, store, counting(log)).count() == 200 and calls(log) == total


def test_later_passes_are_kept_too(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {'odd' if i % 2 else 'even'} {i}") for i in range(30)] + [(90, " "), (91, None)], "id long, text string")
    store, log = str(tmp_path / "store"), str(tmp_path / "calls")
    for _ in range(2):
        got = {r.id: r for r in ask(spark, docs, store, counting(log)).collect()}
        assert calls(log) == 30 + 15 and len(got) == 32
    assert (got[0].attempts, got[1].attempts, got[1].parse_error, got[90].attempts, got[91].predicted_label) == (1, 2, True, 0, "b")


def test_answers_are_stored_and_asked_once_per_key(spark, tmp_path):
    log = str(tmp_path / "calls")
    store = BucketTable(spark, str(tmp_path / "answers"), T.StructType.fromDDL("key string, predicted_label string"), ["key"], 4)
    docs = spark.createDataFrame([(i, f"t{i % 7}", f"some text {i % 7}") for i in range(21)], "id long, key string, text string")
    score = lambda misses: sc.classify_answers(misses, "id", "text", counting(log), ["a", "b"], {}, "b", "{labels} {text}", passes=1)
    assert sc.through_store(docs.where("id < 3"), store, "key", score).count() == 3 and calls(log) == 3
    assert sc.through_store(docs, store, "key", score).count() == 21 and calls(log) == 7


def test_wide_rows(spark):
    df = spark.createDataFrame([(1, "a", "a", 0.5, True, {"a": 0.5}), (2, "b", None, None, False, None)],
                               "id int, true_label string, predicted_label string, confidence double, parse_error boolean, class_scores map<string,double>")
    got = wide_predictions(df, ["a", "b"], audit=["id"], strategy="zero_shot").collect()
    assert [tuple(r) for r in got] == [("zero_shot", "a", "a", 1, 0.5, 1, 1, 0.5, 0.0), ("zero_shot", "b", None, 0, None, 0, 2, 0.0, 0.0)]
    assert got[0].asDict().keys() >= {"is_correct", "score_a", "score_b"}
