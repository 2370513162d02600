"""Quality rules: line and word statistics plus a trained, calibrated text classifier.

Method: logistic regression on hashed word and character n-grams, fitted on
labelled rows, calibrated on a held-out part of them, and applied in Arrow
batches against fixed thresholds.

Defined results: a null text counts as empty; an empty text has zero counts and
fails the base rule (fewer than 20 words); repeated rows are judged one by one;
without labels of both kinds there is no classifier, its probability is null and
only the base rule decides. Labels with a null id or a null value are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import linear
from labelloom.llm.batches import LOWER, SPACE, batch_of, chunks, line_bounds, mix, per_row, span_hashes, word_bounds

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
KEEP_FROM = 0.5
TRAIN_ROWS = 2400  # bound of the labelled sample, half per class where both have as many
BITS = 17
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BUCKET = np.uint64((1 << BITS) - 1)


def counts(data, off):
    """Columns of the base rule for the rows of one chunk, and the bounds of the words."""
    n = len(off) - 1
    starts, ends, row = word_bounds(data, off)
    n_words = np.bincount(row, minlength=n)
    word_chars = per_row(~SPACE[data] & ((data & 0xC0) != 0x80), off)
    n_symbols = per_row(_SYMBOL[data], off)
    of = span_hashes(data)
    words = of(starts, ends)
    # Lines that hold a word, and how many distinct ones each row has.
    l0, l1, lrow = line_bounds(data, off)
    held = np.zeros(len(l0), bool)
    if len(starts):
        held[np.searchsorted(l0, starts, "right") - 1] = True
    lines = mix(of(l0[held], l1[held]) + lrow[held].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(lines)
    fresh = np.ones(len(order), bool)
    fresh[1:] = lines[order][1:] != lines[order][:-1]
    n_dup_lines = np.bincount(lrow[held], minlength=n) - np.bincount(lrow[held][order][fresh], minlength=n)
    # Windows of eight words found twice or more inside the row.
    covered = np.zeros(len(words) + 1, np.int32)
    if len(words) >= WINDOW:
        m = len(words) - WINDOW + 1
        key = np.zeros(m, np.uint64)
        for j in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + words[j:j + m]
        key = mix(key + row[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = np.flatnonzero(row[:m] == row[WINDOW - 1:])
        order = at[np.argsort(key[at])]
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = order[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    n_repeat = np.bincount(row[np.cumsum(covered[:-1]) > 0], minlength=n)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return dict(n_words=n_words, word_chars=word_chars, n_symbols=n_symbols, n_dup_lines=n_dup_lines,
                n_repeat_words=n_repeat, base_failed=failed), (words, row)


def features(data, off, words, row):
    """Hashed slots of words (first half) and of four-byte grams (second half), with their rows.

    Every occurrence weighs one over its kind's number in the row, so a score is a
    mean over the whole text, however long it is.
    """
    slot_w = (words & _BUCKET).astype(np.int64)
    low = LOWER[data].astype(np.uint32)
    m = max(0, len(data) - 3)
    gram = low[:m] | low[1:m + 1] << 8 | low[2:m + 2] << 16 | low[3:m + 3] << 24
    ends = np.repeat(off[1:], np.diff(off))[:m]
    ok = np.arange(m) + 4 <= ends
    slot_c = ((gram[ok] * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64) + (1 << BITS)
    row_c = np.repeat(np.arange(len(off) - 1), np.diff(off))[:m][ok]
    return (slot_w, row), (slot_c, row_c)


def _means(weights, slots, rows, n):
    total = np.bincount(rows, weights[slots], n)
    return total / np.maximum(np.bincount(rows, minlength=n), 1)


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality",
        rows: int = TRAIN_ROWS):
    """Classifier fitted on at most ``rows`` labelled documents, or None without both classes."""
    sample, share = linear.labelled_sample(docs, labels, id_col, text_col, label_col, rows)

    def extract(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch.column("text")):
                _, (words, row) = counts(data, off)
                (sw, rw), (sc, rc) = features(data, off, words, row)
                for r in range(j - i):
                    parts = [np.unique(s[np.searchsorted(k, r):np.searchsorted(k, r, "right")], return_counts=True)
                             for s, k in ((sw, rw), (sc, rc))]
                    slots = np.concatenate([p[0] for p in parts]).astype(np.int32)
                    values = np.concatenate([p[1] / max(p[1].sum(), 1) for p in parts]).astype(np.float32)
                    yield batch_of(key=batch.column("key").slice(i + r, 1), y=batch.column("y").slice(i + r, 1),
                                   slots=pa.array([slots.tobytes()]), values=pa.array([values.tobytes()]))

    table = sample.withColumn("key", F.col("key").cast("string")).mapInArrow(extract, "key string, y int, slots binary, values binary").toArrow()
    return linear.fit(table, share, 2 << BITS, scale=30.0, steps=60)


def _verdict(data, off, model, keep_from):
    """Base columns, probability (None without a model) and verdict of the rows of one chunk."""
    base, (words, row) = counts(data, off)
    if model is None:
        return base, None, ~base["base_failed"]
    z = sum(_means(model.weights, s, r, len(off) - 1) for s, r in features(data, off, words, row))
    p = model.probability(z)
    return base, p, ~base["base_failed"] & (p >= keep_from)


def judge(docs: DataFrame, model, id_col="doc_id", text_col="text", keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: base counts, base verdict, calibrated probability and the verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of hashed weights
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch.column(1)):
                base, p, kept = _verdict(data, off, shared.value, keep_from)
                yield batch_of(**{id_col: batch.column(0).slice(i, j - i)}, **base, kept=kept,
                               probability=pa.nulls(j - i, pa.float64()) if p is None else p)

    schema = (f"`{id_col}` {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
              "n_repeat_words long, base_failed boolean, kept boolean, probability double")
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def keep(docs: DataFrame, model, text_col="text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch.column(at)):
                kept = _verdict(data, off, shared.value, keep_from)[2]
                if kept.any():
                    yield batch.slice(i, j - i).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
