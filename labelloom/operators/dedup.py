"""Duplicate removal that holds when one text makes up a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, value: Column | str, order: str) -> DataFrame:
    """Keep the row with the smallest ``order`` key per value.

    Copies are reduced to (digest, smallest key) by map-side combining, so a hot
    text shuffles one row per map task; whole rows then meet the survivors on
    the unique key.
    """
    value = F.col(value) if isinstance(value, str) else value
    digest = F.sha2(value.cast("string"), 256)
    keep = df.select(digest.alias("__d"), F.col(order)).groupBy("__d").agg(F.min(order).alias(order))
    return df.join(keep.select(order), order, "left_semi")


def dedup_rows(df: DataFrame, columns=("text", "label")) -> DataFrame:
    return df.select(*columns).distinct()


def split_by_cache(df: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a cached prediction (joined to it) and rows still to score."""
    hits = df.join(cache, key, "inner")
    misses = df.join(cache.select(key), key, "left_anti")
    return hits, misses
