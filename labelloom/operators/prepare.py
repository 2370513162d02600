"""Schema handling, projections and row filters of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.session import checked_broadcast

# Header synonyms and binary label spellings.
COLUMN_SYNONYMS = {
    "text": ("text", "message", "email", "sms", "content", "body"),
    "label": ("label", "class", "category", "spam", "target"),
}
BINARY_LABELS = {"spam": 1, "1": 1, "yes": 1, "true": 1, "ham": 0, "0": 0, "no": 0, "false": 0}


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim and lower-case the header; a leading ``#`` is dropped."""
    return df.toDF(*[c.strip().lower().lstrip("#").strip() for c in df.columns])


def map_columns(df: DataFrame, synonyms=None) -> DataFrame:
    """Rename known synonyms to their standard name."""
    synonyms = synonyms or COLUMN_SYNONYMS
    renames = {c: std for c in df.columns for std, names in synonyms.items() if c in names}
    return df.withColumnsRenamed(renames)


def label_candidates(df: DataFrame, candidates: list[str], expected: int) -> DataFrame:
    """One row per candidate column: distinct count, distance to ``expected``, chosen flag."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in candidates])
    rows = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column_name"), F.col(c).alias("n_distinct"),
                 F.abs(F.col(c) - expected).alias("distance"))
        for i, c in enumerate(candidates)
    ])
    best = F.array_min(F.transform(rows, lambda r: F.struct(r["distance"], r["pos"])))["pos"]
    long = counts.select(best.alias("best"), F.explode(rows).alias("r"))
    return long.select("r.column_name", "r.n_distinct", "r.distance",
                       (F.col("r.pos") == F.col("best")).alias("chosen"))


def detect_label_column(df: DataFrame, candidates: list[str], expected: int) -> str:
    return label_candidates(df, candidates, expected).where("chosen").first()["column_name"]


def working_set(df: DataFrame, key: str, text: str, label: str) -> DataFrame:
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(label).alias("label"))


def drop_missing(df: DataFrame, subset=("text", "label")) -> DataFrame:
    return df.dropna(subset=list(subset))


def drop_blank(df: DataFrame, subset=("text", "label")) -> DataFrame:
    for c in subset:
        df = df.withColumn(c, tx.strip(c))
    for c in subset:
        df = df.where(F.col(c) != "")
    return df


def known_labels(df: DataFrame, labels, label: str = "label") -> DataFrame:
    """Rows whose label is in a closed list (a Python list) or in a label table."""
    if isinstance(labels, DataFrame):
        keep = checked_broadcast(labels.select(F.col(labels.columns[0]).alias(label)).distinct())
        return df.join(keep, label, "left_semi")
    return df.where(F.col(label).isin(list(labels)))


def rejects(df: DataFrame, labels, text: str = "text", label: str = "label") -> DataFrame:
    """Rows per drop reason, in one pass."""
    reason = (
        F.when(F.col(text).isNull(), "null_text")
        .when(F.col(label).isNull(), "null_label")
        .when(tx.strip(text) == "", "blank_text")
        .when(~F.col(label).isin(list(labels)), "unknown_label")
        .otherwise("kept")
    )
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def unknown_labels(df: DataFrame, labels, label: str = "label", n: int = 10) -> DataFrame:
    """The first ``n`` labels outside the list, sorted, with their counts."""
    return (
        df.where(F.col(label).isNotNull() & ~F.col(label).isin(list(labels)))
        .groupBy(label).agg(F.count("*").alias("n")).orderBy(label).limit(n)
    )


def head_by_key(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def attach_audit(preds: DataFrame, corpus: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add audit columns to predictions after scoring."""
    return preds.join(corpus.select(key, *columns), key, "left")


def binary_label(df: DataFrame, label: str, mapping=None, out: str = "label") -> DataFrame:
    """Spelled binary labels to 1/0; other values are dropped."""
    mapping = mapping or BINARY_LABELS
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    value = F.element_at(table, F.lower(tx.strip(F.col(label).cast("string"))))
    return df.withColumn(out, value).where(F.col(out).isNotNull())


def index_labels(df: DataFrame, labels: list, label: str, positive=None, out: str = "label_index") -> DataFrame:
    """0..k-1 in sorted label order; with ``positive`` that label becomes 1 of two."""
    ordered = sorted(labels)
    if positive is not None and len(ordered) == 2:
        ordered = sorted(ordered, key=lambda l: l == positive)
    table = F.create_map(*[F.lit(x) for i, l in enumerate(ordered) for x in (l, i)])
    return df.withColumn(out, F.try_element_at(table, F.col(label)))


def binarize(df: DataFrame, key: str, true_label: str, labels: list) -> DataFrame:
    """Long-form class indicator: a row per (key, label) from a literal label array."""
    return df.select(key, F.col(true_label).alias("__t"), F.explode(F.array(*[F.lit(l) for l in labels])).alias("label")) \
        .select(key, "label", F.coalesce((F.col("label") == F.col("__t")).cast("int"), F.lit(0)).alias("indicator"))


def error_rows(preds: DataFrame, true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """Wrong or unparsable predictions."""
    return preds.where(F.col("parse_error") | ~F.col(true).eqNullSafe(F.col(pred)))
