"""Exploratory profile of a corpus."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import shuffle_width


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def crosstab(df: DataFrame, rows: str, columns: str, values: list, prefix: str = "") -> DataFrame:
    """Counts of ``rows`` by each listed value of ``columns``, in one pass."""
    cells = [F.count_if(F.col(columns) == F.lit(v)).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(rows).agg(*cells)


def counts_filled(df: DataFrame, a: str, b: str, order_a: list, order_b: list) -> DataFrame:
    """Counts over every pair of two closed lists; missing pairs are 0."""
    have = df.where(F.col(a).isin(order_a) & F.col(b).isin(order_b)).groupBy(a, b).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(v) for v in order_a])).alias(a)
    ).withColumn(b, F.explode(F.array(*[F.lit(v) for v in order_b]))).withColumn("n", F.lit(0).cast("bigint"))
    return have.unionByName(grid).groupBy(a, b).agg(F.sum("n").alias("n"))


def flag_rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """Count and share of true values per boolean column, in one pass."""
    sums = df.agg(F.count("*").alias("__n"), *[F.count_if(f).alias(f) for f in flags])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.col(f).alias("n_true"), F.when(F.col("__n") > 0, F.col(f) / F.col("__n")).alias("share"))
        for f in flags
    ])))


def summary(df: DataFrame, label: str, language: str) -> DataFrame:
    """Rows, classes, languages and the largest class (ties by name) in one row."""
    per = df.groupBy(label, language).agg(F.count("*").alias("n"))
    per_label = per.groupBy(label).agg(F.sum("n").alias("n"), F.collect_set(language).alias("langs"))
    top = F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label)))
    return per_label.agg(
        F.sum("n").alias("n_rows"), F.count(label).alias("n_classes"),
        F.size(F.array_distinct(F.flatten(F.collect_list("langs")))).cast("bigint").alias("n_languages"),
        top.alias("top_class"), F.max("n").alias("top_n"),
    )


def length_profile(df: DataFrame, text: str, by=()) -> DataFrame:
    """Shortest, median and longest text; lengths collapse to counts before the percentile."""
    sizes = df.groupBy(*by, F.length(text).alias("len")).agg(F.count("*").alias("n"))
    return sizes.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("len").alias("min_len"),
        F.percentile("len", 0.5, F.col("n")).alias("median_len"), F.max("len").alias("max_len"),
    )


def rare(df: DataFrame, label: str, minimum: int = 5) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") < minimum)


def store_stats(df: DataFrame, error: str, model: str, kind: str) -> DataFrame:
    """Totals, errors, success rate and the number of models and types, in one pass."""
    return df.agg(
        F.count("*").alias("total_records"), F.count_if(error).alias("errors"),
        F.when(F.count("*") > 0, (F.count("*") - F.count_if(error)) / F.count("*") * 100).alias("success_rate"),
        F.count_distinct(model).alias("models_used"), F.count_distinct(kind).alias("types"),
    )


def response_records(prompts: DataFrame, responses: DataFrame, key: str, context: str) -> DataFrame:
    """Prompt metadata joined with its response; the context is cut to 200 characters."""
    return prompts.join(responses, key).withColumn(context, F.substring(context, 1, 200))


# Two primes below 2**31 and a base: products stay within 64 bits, so SQL can state the digest.
DIGEST_PRIMES, DIGEST_BASE = (2147483647, 2147483629), 1_000_003


def ordered_digest(df: DataFrame, key: str, text: str) -> DataFrame:
    """(n, digest): number of rows and 16 hexadecimal digits that depend on every key and text and on the rows' order by key.

    A polynomial hash of the row hashes. Hashes of consecutive pieces combine, by (length, hash), to the hash of the whole,
    so every range of keys is reduced where it lies and any partitioning gives the same digest. Rows with equal
    keys are ordered by their text's hash; a null counts as a text of its own.
    """
    row = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("\0")), F.coalesce(F.col(text), F.lit("\0"))))
    parts = [(F.conv(F.substring(row, at, 15), 16, 10).cast("bigint") % p).alias(f"h{i}") for i, (at, p) in enumerate(zip((1, 17), DIGEST_PRIMES))]
    rows = df.select(F.col(key).alias("key"), row.alias("row"), *parts)
    width = shuffle_width(df.sparkSession)
    ordered = rows.repartitionByRange(width, F.col("key").asc_nulls_first(), "row").sortWithinPartitions(F.col("key").asc_nulls_first(), "row")

    def reduce_piece(batches):
        n, hashes = 0, [0, 0]
        for batch in batches:
            n += batch.num_rows
            for i, p in enumerate(DIGEST_PRIMES):
                acc = hashes[i]
                for h in batch.column(f"h{i}").to_pylist():
                    acc = (acc * DIGEST_BASE + h) % p
                hashes[i] = acc
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), n, *hashes)], ["piece", "n", "h0", "h1"])

    pieces = ordered.mapInArrow(reduce_piece, "piece long, n long, h0 long, h1 long").collect()  # a row per partition
    n, whole = 0, [0, 0]
    for r in sorted(pieces, key=lambda r: r["piece"]):
        n += r["n"]
        whole = [(w * pow(DIGEST_BASE, r["n"], p) + r[f"h{i}"]) % p for i, (w, p) in enumerate(zip(whole, DIGEST_PRIMES))]
    return df.sparkSession.createDataFrame([(n, "".join(f"{w:08x}" for w in whole))], "n long, digest string")
