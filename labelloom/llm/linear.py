"""Logistic regression over hashed sparse features, fitted on a bounded labelled sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import materialize


@dataclass
class Linear:
    """Weights of the hashed slots and the calibration ``sigmoid(a * z + b)``."""

    weights: np.ndarray
    a: float
    b: float

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.a * z + self.b, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int,
                    only=None) -> tuple[DataFrame, tuple[int, int]]:
    """At most ``rows`` labelled texts (key, y, text), up to half of them per class, and the labelled rows of each class.

    The draw takes the smallest digests per class, so it does not depend on order
    or partitioning. Only its ids, at most ``rows``, meet the documents. ``only`` is
    a condition on the id, given a Column. Conflicting labels of one id count by the larger.
    """
    id_type = docs.schema[id_col].dataType
    lab = (labels.select(F.col(id_col).cast(id_type).alias("key"), F.col(label_col).cast("int").alias("y"))
           .where(F.col("key").isNotNull() & F.col("y").isin(0, 1)))
    if only is not None:
        lab = lab.where(only(F.col("key")))
    lab = lab.groupBy("key").agg(F.max("y").alias("y"))
    digest = F.xxhash64(F.lit("sample"), F.col("key").cast("string"))
    # Labels of ids that aren't there don't count; a semi join on ids alone, before any text moves.
    lab = materialize(lab.join(docs.select(F.col(id_col).alias("key")), "key", "left_semi"), "labelled")
    share = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = lab.where(F.col("y") == y).withColumn("_d", digest).orderBy("_d", "key").limit(rows // 2).drop("_d")
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    # At most `rows` pairs of numbers: small enough for every task whatever the input.
    found = texts.join(F.broadcast(picked), "key").groupBy("key").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    return found.where(F.col("text").isNotNull()), (share.get(0, 0), share.get(1, 0))


def _dot(w, slots, values, bounds):
    sums = np.concatenate([[0.0], np.cumsum(w[slots] * values, dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def fit(table, share: tuple[int, int], size: int, scale: float = 1.0, l2: float = 1e-4, steps: int = 120,
        weight_of=None) -> Linear | None:
    """Fit on an Arrow table (key, y, slots binary, values binary); None without both classes.

    A fifth of the rows, chosen by order of the key, is left out of the fit and calibrates
    the probability, its classes weighted to their ``share`` among all labelled rows. ``scale`` multiplies the values during the fit and ends up in
    the weights. ``weight_of`` maps (slots, values, bounds, y) to per-slot factors
    computed from the fitted rows only.
    """
    order = np.argsort(np.array(table["key"].to_pylist(), dtype=object).astype(str), kind="stable")
    y = np.array(table["y"].to_pylist(), dtype=np.float64)[order] if table.num_rows else np.zeros(0)
    if not (0 < y.sum() < len(y)):
        return None
    slots_of, values_of = table["slots"].to_pylist(), table["values"].to_pylist()
    slots = [np.frombuffer(slots_of[i], np.int32) for i in order]
    values = [np.frombuffer(values_of[i], np.float32) for i in order]
    held = np.arange(len(y)) % 5 == 4
    if not (0 < y[~held].sum() < (~held).sum()) or not (0 < y[held].sum() < held.sum()):
        held = np.zeros(len(y), bool)

    def pack(which):
        rows = np.flatnonzero(which)
        bounds = np.concatenate([[0], np.cumsum([len(slots[i]) for i in rows])])
        return (np.concatenate([slots[i] for i in rows]), np.concatenate([values[i] for i in rows]) * np.float32(scale),
                bounds, y[rows])

    s, v, bounds, target = pack(~held)
    factor = None
    if weight_of is not None:
        factor = weight_of(s, v, bounds, target)
        v = v * factor[s].astype(np.float32)
    row = np.repeat(np.arange(len(target)), np.diff(bounds))
    # Classes weigh the same in the fit; calibration brings back their real shares.
    balance = np.where(target > 0, 0.5 / target.mean(), 0.5 / (1 - target.mean())) / len(target)
    w, bias = np.zeros(size), 0.0
    m, q, mb, qb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        z = _dot(w, s, v, bounds) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * balance
        gw = np.bincount(s, v * g[row], size) + l2 * w
        gb = g.sum()
        m, q = 0.9 * m + 0.1 * gw, 0.99 * q + 0.01 * gw * gw
        mb, qb = 0.9 * mb + 0.1 * gb, 0.99 * qb + 0.01 * gb * gb
        rate = 0.1 * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
        w = w - rate * m / (np.sqrt(q) + 1e-8)
        bias -= rate * mb / (qb**0.5 + 1e-8)
    s, v, bounds, target = pack(held if held.any() else ~held)
    if factor is not None:
        v = v * factor[s].astype(np.float32)
    real = np.where(target > 0, share[1] / sum(share) / target.mean(), share[0] / sum(share) / (1 - target.mean()))
    a, b = calibrate(_dot(w, s, v, bounds) + bias, target, real)
    if factor is not None:
        w = w * factor
    return Linear((w * scale).astype(np.float32), a, b + a * bias)


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit of y on z with smoothed targets (Newton steps)."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t = np.where(y > 0, hi, lo)
    centre, spread = z.mean(), z.std() + 1e-9
    x = (z - centre) / spread
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        k = weight * (p * (1 - p) + 1e-9)
        r = weight * (p - t)
        ga, gb = (r * x).sum() + 1e-3 * a, r.sum()
        haa, hab, hbb = (k * x * x).sum() + 1e-3, (k * x).sum(), k.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
    a = max(a, 1e-6)
    return a / spread, b - a * centre / spread
