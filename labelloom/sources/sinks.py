"""Sinks: delimited text, JSON lines, parquet, vector stores, splits and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_corpus(df: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    """All fields quoted, quotes doubled, header in every part file.

    A multi-line file cannot be split by readers, so files are kept small.
    """
    (
        df.write.mode(mode).option("header", True).option("sep", sep)
        .option("quoteAll", True).option("escape", '"').option("quote", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", 100_000).csv(path)
    )


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def store_vectors(df: DataFrame, path: str, label: str = "class_label") -> None:
    """Drop and rewrite a vector collection, clustered by label.

    The range split uses label and key, so one dominant label spreads over many
    files while min/max statistics still prune label filters.
    """
    df.repartitionByRange(label, *[c for c in df.columns if c == "id"]).sortWithinPartitions(label) \
        .write.mode("overwrite").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def describe_store(df: DataFrame, label: str = "class_label") -> DataFrame:
    """Row count, number of classes and the sorted class list in one row."""
    per_label = df.groupBy(label).agg(F.count("*").alias("n"))
    return per_label.agg(
        F.sum("n").alias("n_rows"),
        F.count(label).alias("n_classes"),
        F.array_join(F.sort_array(F.collect_list(F.col(label).cast("string"))), ",").alias("classes"),
    )


def write_splits(df: DataFrame, path: str, label: str = "label", split: str = "split") -> None:
    """Train/test tables under ``split=...`` folders and the closed label list beside them."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/rows")
    df.select(label).distinct().write.mode("overwrite").parquet(f"{path}/labels")


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/labels")


def wide_predictions(df: DataFrame, labels, true: str = "true_label", pred: str = "predicted_label", scores: str = "class_scores",
                     audit=(), **named) -> DataFrame:
    """One row per answer as result files hold it: the named values, both labels, ``is_correct`` and ``parse_error`` as 0/1,
    a column ``score_<label>`` per label (0 where the answer names none) and the audit columns as they came.
    """
    flags = [F.col("parse_error").cast("int").alias("parse_error")] if "parse_error" in df.columns else []
    right = F.coalesce(F.col(true) == F.col(pred), F.lit(False)).cast("int")
    return df.select(
        *[F.lit(x).alias(k) for k, x in named.items()], F.col(true).alias("true_label"), F.col(pred).alias("predicted_label"),
        right.alias("is_correct"), "confidence", *flags, *audit,
        *[F.coalesce(F.col(scores)[l], F.lit(0.0)).alias(f"score_{l}") for l in labels])


def export_run(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Write each report of a run as its own table; returns the paths by name."""
    out = {}
    for name, table in tables.items():
        out[name] = f"{path}/{name}"
        table.write.mode("overwrite").parquet(out[name])
    return out


def merge_results(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Result table where new rows replace old rows with the same keys."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
