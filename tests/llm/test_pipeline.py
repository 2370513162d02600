"""The corpus pipeline stage by stage against what each must do."""

import edge
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from labelloom.llm import packing, quality, secrets, simhash
from labelloom.session import materialize


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf), name))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_quality_stage_keeps_what_the_rules_keep(spark, sf, stages):
    model = quality.fit(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    kept = quality.judge(stages[0], model).where("kept").select("doc_id")
    assert sorted(kept.collect()) == sorted(stages[1].select("doc_id").collect())
    assert stages[1].exceptAll(stages[0]).count() == 0


def test_one_of_each_group_stays(stages):
    comps = simhash.near_duplicates(stages[1]).select("component_id").distinct()
    assert sorted(comps.collect()) == sorted(stages[2].select("doc_id").collect())
    assert simhash.near_duplicates(stages[2]).where("doc_id <> component_id").count() == 0


def test_repeats_and_secrets_are_gone(stages):
    import test_pairs

    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {k: t for (k, _), (raw, gone) in zip(rows, test_pairs.cut([t for _, t in rows]))
            for t in [test_pairs.np.frombuffer(raw, test_pairs.np.uint8)[~gone].tobytes().decode("utf-8", "ignore")]}
    assert {r.doc_id: r.text for r in stages[3].collect()} == want
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())
    left = secrets.scan(stages[4]).where(F.size(secrets.SPANS) > 0)
    assert left.count() == 0
    assert stages[4].count() == stages[3].count()
    hit = secrets.scan(stages[3]).where(F.size(secrets.SPANS) > 0).select("doc_id")
    assert sorted(stages[4].where("contains(text, '[SECRET]')").select("doc_id").collect()) == sorted(hit.collect())


def test_everything_left_is_packed(stages):
    want = packing.pack(stages[4]).agg(F.sum("length")).first()[0]
    got = stages[5].agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert tuple(got) == (want, stages[4].count())


def test_edge_rows_pass_through_every_stage(spark, sf):
    for docs in (edge.table(spark, edge.rows()), edge.empty(spark)):
        columns = docs.columns
        for name, stage in pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf), name)
            assert docs.columns == columns, name
        pipeline.STAGES[-1][1](spark, docs, sf).count()
