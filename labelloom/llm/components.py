"""Connected components of a link table, as alternating star contractions over DataFrames.

Every round replaces links by links to the smallest neighbour, first from the larger
neighbours of each node, then from the smaller ones, until only stars are left.
Minima are pre-aggregated per task, so a node with very many links costs one row per
task; every round is written to the shared folder, which cuts the lineage and
survives lost executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import materialize


def _digest(links: DataFrame):
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node with a link in ``links`` (u, v longs); the component is its smallest node."""
    e = materialize(links.select("u", "v").where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _digest(e)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written minima leave the join plain, so that a node with very many links can be split.
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        state, before = _digest(e), state
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the pairs (a, b), inside one task."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        root = new[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def groups(batches, keys):
    """Consecutive rows with equal keys as one table each, from batches sorted by the keys."""
    left = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if left is not None:
            table = pa.concat_tables([left, table])
        cols = [table[k].to_numpy() for k in keys]
        cut = np.zeros(table.num_rows - 1, bool)
        for c in cols:
            cut |= c[1:] != c[:-1]
        bounds = [0, *(np.flatnonzero(cut) + 1)]
        for i, j in zip(bounds, bounds[1:]):
            yield table.slice(i, j - i)
        left = table.slice(bounds[-1]).combine_chunks()
    if left is not None:
        yield left
