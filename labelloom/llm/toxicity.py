"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Method: the set of hashed three-, four- and five-byte grams of the lower-cased
text; each gram's value is its naive Bayes log-count ratio learned from labelled
texts, on which a logistic regression is fitted. Scores are calibrated.

Defined results: a null text counts as empty; an empty text gets the score of no
evidence, that is the calibrated offset alone; repeated rows are scored one by one; without labels of
both kinds every score is the share of label 1 (0 without labels). A row with a
null id is scored, never held out and never learned from.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import linear
from labelloom.llm.batches import LOWER, SPACE, batch_of, chunks

TRAIN_ROWS = 1600  # bound of the labelled sample, half per class where both have as many
BITS, ORDERS = 19, (3, 4, 5)
HOLD = 5


def grams(data: np.ndarray) -> np.ndarray:
    """Distinct hashed grams of one text, blanks folded to one kind, with a blank at both ends."""
    low = LOWER[data]
    b = np.full(len(data) + 2, 32, np.uint8)
    b[1:-1] = np.where(SPACE[data], 32, low)
    b = b.astype(np.uint64)
    found = []
    for n in ORDERS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        g = b[:m].copy()
        for j in range(1, n):
            g |= b[j:j + m] << np.uint64(8 * j)
        found.append((((g + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    slots = np.concatenate(found) if found else np.zeros(0, np.int32)
    # The last writer of a slot marks it: distinct values without a sort.
    _mark[slots] = places = np.arange(len(slots), dtype=np.int32)
    return slots[_mark[slots] == places]


_mark = np.zeros(1 << BITS, np.int32)


def log_count_ratio(slots, values, bounds, y, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of a gram's share of the positive texts' grams to its share of the negative texts' grams."""
    row = np.repeat(np.arange(len(y)), np.diff(bounds))
    positive = y[row] > 0
    p = np.bincount(slots[positive], minlength=1 << BITS) + smooth
    q = np.bincount(slots[~positive], minlength=1 << BITS) + smooth
    # Classes differ in size: compare document frequencies, smoothed by one document.
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    return np.log((p / (n1 + 2 * smooth)) / (q / (n0 + 2 * smooth)))


def remainder(key, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % n


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", rows: int = TRAIN_ROWS,
        only=lambda key: remainder(key, HOLD) != 0):
    """Classifier of at most ``rows`` labelled documents whose id meets ``only``; also the share of label 1."""
    sample, share = linear.labelled_sample(docs, labels, id_col, text_col, label_col, rows, only)

    def extract(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch.column("text")):
                for r in range(j - i):
                    slots = np.sort(grams(data[off[r]:off[r + 1]]))
                    values = np.full(len(slots), 1 / np.sqrt(max(1, len(slots))), np.float32)
                    yield batch_of(key=batch.column("key").slice(i + r, 1), y=batch.column("y").slice(i + r, 1),
                                   slots=pa.array([slots.tobytes()]), values=pa.array([values.tobytes()]))

    table = sample.withColumn("key", F.col("key").cast("string")).mapInArrow(extract, "key string, y int, slots binary, values binary").toArrow()
    return linear.fit(table, share, 1 << BITS, scale=3.0, l2=1e-4, steps=40, weight_of=log_count_ratio), share[1] / max(1, sum(share))


def score(docs: DataFrame, fitted, id_col="doc_id", text_col="text", hold: int = HOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # a fixed number of hashed weights
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model, rate = shared.value
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out = np.full(len(keys), rate)
            if model is not None:
                for i, j, data, off in chunks(batch.column(1)):
                    z = np.zeros(j - i)
                    for r in range(j - i):
                        slots = grams(data[off[r]:off[r + 1]])
                        z[r] = model.weights[slots].sum(dtype=np.float64) / np.sqrt(max(1, len(slots)))
                    out[i:j] = model.probability(z)
            held = [k is not None and zlib.crc32(str(k).encode()) % hold == 0 for k in keys]
            yield batch_of(**{id_col: batch.column(0)}, held_out=pa.array(held, pa.bool_()), score=out,
                           predicted=(out >= 0.5).astype(np.int32))

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")
