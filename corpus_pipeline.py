"""Corpus pipeline: from raw documents to packed training sequences.

Each stage gets the table the stage before has written, works on all of it and hands on what it decides:
rejected documents are gone, one document of every near-duplicate group stays, repeated strings are cut out, secrets
are masked, and what is left is packed. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.llm import quality, secrets, simhash, suffixes
from labelloom.llm.queries_text import packing_rows
from labelloom.session import materialize, ship_package


def _sized(docs):
    """Keeps n_chars, where there is one, the length of the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rule and the classifier of labelled quality."""
    ship_package(spark)
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_dedup(spark, docs, sf_dir):
    """One document of every group of near duplicates."""
    ship_package(spark)
    return simhash.keep_one(docs)


def suffix_dedup(spark, docs, sf_dir):
    """Documents without the bytes of long strings found elsewhere."""
    ship_package(spark)
    return _sized(suffixes.without_repeats(docs))


def secret_scan(spark, docs, sf_dir):
    """Documents with every secret masked."""
    ship_package(spark)
    found = secrets.scan(docs)
    return _sized(found.withColumn("text", secrets.masked(F.col("text"), F.col(secrets.SPANS))).select(*docs.columns))


def packing(spark, docs, sf_dir):
    """Pieces of the documents in training sequences."""
    ship_package(spark)
    return packing_rows(docs)


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("suffix_dedup", suffix_dedup),
          ("secret_scan", secret_scan), ("packing", packing)]

#: A trained classifier, anchors and a tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
