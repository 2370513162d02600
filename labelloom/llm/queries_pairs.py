"""Registered queries of the two near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.llm import embeddings, simhash, suffixes
from labelloom.llm.registry import query


@query("op1_embedding_dedup")
def op1_embedding_dedup(spark, d):
    """Links and components of all vectors at cosine 0.95 or more."""
    return embeddings.near_duplicates(spark.read.parquet(f"{d}/embeddings.parquet"))


@query("op3_simhash_dedup")
def op3_simhash_dedup(spark, d):
    """Fingerprints and components of all documents at four differing bits or fewer."""
    return simhash.near_duplicates(spark.read.parquet(f"{d}/documents.parquet"))


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, d):
    """What is left of every document without the bytes of strings of 200 bytes that also start elsewhere."""
    out = suffixes.remove_repeats(spark.read.parquet(f"{d}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["stop"] - s["start"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
