"""Registered queries of the trained and the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.llm import bpe, lm, packing, quality, toxicity
from labelloom.llm.registry import query


def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def labels(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet")


@query("op2_quality_rules")
def op2_quality_rules(spark, d):
    """Base counts, base verdict and the trained verdict of every document."""
    docs = documents(spark, d)
    return quality.judge(docs, quality.fit(docs, labels(spark, d)))


@query("op4_toxicity")
def op4_toxicity(spark, d):
    """Toxicity score of every document, learned from the rows that are not held out."""
    docs = documents(spark, d)
    return toxicity.score(docs, toxicity.fit(docs, labels(spark, d)))


@query("op5_packing")
def op5_packing(spark, d):
    """All pieces of all documents in sequences of 2,048 ids."""
    return packing_rows(documents(spark, d))


def packing_rows(docs):
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                     "sequence_id", "offset")


@query("op6_byte_bpe")
def op6_byte_bpe(spark, d):
    """Token ids of every document and the bytes they decode to."""
    rows = bpe.decode(bpe.encode(documents(spark, d)))
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_lm_score")
def op8_lm_score(spark, d):
    """Base and model log probability of every document."""
    docs = documents(spark, d)
    model, counts = lm.fit(docs)
    return lm.score(docs, model, counts)
