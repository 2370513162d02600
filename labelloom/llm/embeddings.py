"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, components.

Identical vectors are one class. Every class is hashed in several tables by the signs of its products with fixed random
hyperplanes; classes that meet in a bucket are compared exactly in double precision, block by block
inside the task. A pair that meets in several tables counts in the first one alone, known from
the hash codes both carry, so no pair ever leaves its task: only link counts and a spanning forest do.
Buckets beyond a bound are cut into blocks whose pairs of blocks are separate tasks.

Table number and code width follow the number of classes: a pair at the threshold is missed with probability
``MISS`` at most, and a bucket holds about ``PER_BUCKET`` classes.

Defined results: null, zero or empty vectors, those with null or non-finite parts, and rows
with a null id link with nothing; vectors of different lengths don't link; repeated rows
are vectors of their own and link with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.batches import batch_of
from labelloom.llm.components import components, groups, local_roots
from labelloom.session import materialize, shuffle_width

THRESHOLD, MISS, PER_BUCKET, BLOCK, SEED = 0.95, 1e-5, 256, 2048, 7


def plan_tables(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n classes."""
    bits = max(2, min(30, round(math.log2(max(1, n) / PER_BUCKET)) if n > PER_BUCKET else 2))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def _vectors(column) -> np.ndarray:
    """Matrix of a list column whose rows have equal lengths."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled by the largest part first, so that very small or large parts neither vanish nor overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(rows: DataFrame, id_col="vec_id", vec_col="embedding", threshold: float = THRESHOLD,
                    miss: float = MISS) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col(id_col).isNotNull() & vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    base = rows.select(F.col(id_col).alias("id"), F.when(valid, vec).alias("vec"))
    classes = base.where("vec is not null").groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "classes")
    found = materialize(_bucket_links(classes, threshold, miss), "bucket-links")
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    comp = components(found.where("v is not null").select("u", "v"))
    rooted = classes.select("node", "first", "copies", "vec").join(comp, "node", "left").join(counts, "node", "left")
    rooted = rooted.withColumn("component", F.coalesce("component", "node"))
    least = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    known = rooted.join(least, "component").select(
        "vec", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = base.where("vec is not null").join(known, "vec").select("id", "n_links", "component_id")
    alone = base.where("vec is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("bigint").alias("n_links"),
                      F.col("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _bucket_links(classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Rows (u, v, n): partial link counts n of class u where v is null, links of the forest elsewhere."""
    width = shuffle_width(classes.sparkSession)
    bits, tables = plan_tables(classes.count(), threshold, miss)

    def hashed(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                unit = _unit(_vectors(some.column("vec")))
                planes = np.random.default_rng([SEED, int(dim)]).standard_normal((int(dim), tables * bits))
                signs = (unit @ planes >= 0).reshape(-1, tables, bits)
                codes = (signs << np.arange(bits)).sum(axis=2).astype(np.int32)
                own = pa.array([c.tobytes() for c in codes])
                for t in range(tables):
                    yield batch_of(tab=np.full(some.num_rows, t, np.int32), code=codes[:, t].copy(), dim=some.column("dim"),
                                   node=some.column("node"), copies=some.column("copies"), codes=own, vec=some.column("vec"))

    kind = classes.schema["vec"].dataType.simpleString()
    sent = classes.select("node", "copies", "dim", "vec").mapInArrow(
        hashed, f"tab int, code int, dim int, node long, copies long, codes binary, vec {kind}")
    key = ["tab", "code", "dim"]
    hot = sent.groupBy(*key).count().where(F.col("count") > BLOCK)
    hot = materialize(hot.select(*key, F.ceil(F.col("count") / (BLOCK // 2)).cast("int").alias("blocks")), "hot")
    if hot.isEmpty():
        sent = sent.withColumns({"mine": F.lit(0), "one": F.lit(0), "two": F.lit(0)})
    else:
        sent = sent.join(hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        sent = sent.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sent = sent.withColumns({"one": F.least("mine", "other"), "two": F.greatest("mine", "other")}).drop("other", "blocks")
    key = [*key, "one", "two"]
    dealt = sent.repartition(width, *key).sortWithinPartitions(*key, "mine")

    def compare(batches):
        for g in groups(batches, key):
            n = g.num_rows
            node, copies, mine = g["node"].to_numpy(), g["copies"].to_numpy(), g["mine"].to_numpy()
            codes = np.frombuffer(b"".join(g["codes"].to_pylist()), np.int32).reshape(n, tables)
            unit, tab = _unit(_vectors(g["vec"])), g["tab"][0].as_py()
            # With two blocks, the first one is compared with the second; else the block with itself.
            cut = int(np.searchsorted(mine, g["two"][0].as_py())) if g["one"][0].as_py() != g["two"][0].as_py() else 0
            links, pa_, pb_ = np.zeros(n, np.int64), [], []
            for i in range(0, cut or n, 512):
                left = slice(i, min(i + 512, cut or n))
                for j in range(cut or i, n, 512):
                    right = slice(j, min(j + 512, n))
                    a, b = np.nonzero(unit[left] @ unit[right].T >= threshold)
                    a, b = a + left.start, b + right.start
                    if not cut:
                        a, b = a[a < b], b[a < b]
                    first = ~(codes[a, :tab] == codes[b, :tab]).any(axis=1)
                    a, b = a[first], b[first]
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    # Only what joins parts is kept of the block's links.
                    r = local_roots(n, a, b)
                    m = np.flatnonzero(r != np.arange(n))
                    pa_.append(m)
                    pb_.append(r[m])
            if not pa_:
                continue
            root = local_roots(n, np.concatenate(pa_), np.concatenate(pb_))
            moved, some = np.flatnonzero(root != np.arange(n)), np.flatnonzero(links)
            if len(some):
                yield batch_of(u=np.concatenate([node[some], node[moved]]),
                               v=pa.array([*[None] * len(some), *node[root[moved]].tolist()], pa.int64()),
                               n=np.concatenate([links[some], np.zeros(len(moved), np.int64)]))

    return dealt.mapInArrow(compare, "u long, v long, n long")
