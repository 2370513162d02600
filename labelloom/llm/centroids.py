"""Centroid clustering: Lloyd rounds sharded over the dimensions, in whole numbers.

Vectors are cut into blocks of ``ROWS`` rows and every block into column shards of ``WIDTH`` components. A task holds
one shard of one block and the slice of the centroids with the same columns, so it computes exact partial distances of
its rows to all centroids. The partial distances of a block are added over its shards by key and the arg-min is taken
there; the assignment goes back to the shards, each of which sums its own columns per cluster and updates its own slice.
Neither whole vectors nor whole centroids meet in a task; the slices of all shards are k times d numbers.

Sums leave a task as one number per cluster and column, so a cluster that holds most rows is no hot spot, and are added by key.

Defined results: a vector is kept if it has exactly ``dims`` components, none null or non-finite, and none beyond
``LARGEST`` after scaling (distances are longs); ids may be null (hashed as an empty string) or repeated, every row
counts; with fewer kept vectors than ``k`` there are fewer centroids; vectors with the same id and hash start in order
of their components; no kept vector, no row; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.batches import batch_of
from labelloom.session import materialize

ROWS = 4096
WIDTH = 16
LARGEST = 1 << 26
SCALE = 64


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int = SCALE) -> DataFrame:
    """(id, v): kept vectors with every component as floor(scale * x)."""
    x = F.col(vec_col).cast("array<double>")
    number = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < LARGEST))
    rows = df.select(F.col(id_col).alias("id"), x.alias("x"), (F.size(x) == dims).alias("fits"), number.alias("number"))
    return rows.where("fits and number").select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str = "1:") -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of salt and id, in that order: k times d numbers."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in rows.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()]


def _blocks(rows: DataFrame, dims: int) -> DataFrame:
    """(block, shard, ids, part): column shards of blocks of rows; part is rows x columns of longs."""

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                v = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                ids = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), pa.concat_arrays([some.column(0)]))
                none = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.concat_arrays([some.column(0).slice(0, 0)]))
                for shard in range(-(-dims // WIDTH)):
                    part = np.ascontiguousarray(v[:, shard * WIDTH:(shard + 1) * WIDTH], np.int64)
                    yield batch_of(block=np.array([(task << 32) | n]), shard=np.array([shard], np.int32), ids=none if shard else ids,
                                   part=pa.array([part.tobytes()], pa.binary()))
                n += 1

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "v").mapInArrow(run, f"block long, shard int, ids array<{kind}>, part binary")


def _longs(raw: bytes, *shape) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(*shape)


def _partial(blocks: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """(block, far): per column shard the squared distances of its rows to the centroids, in its columns."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = _longs(row["slice"], k, -1)
                part = _longs(row["part"], -1, c.shape[1])
                far = np.stack([((part - c[j]) ** 2).sum(axis=1) for j in range(k)], axis=1)
                yield batch_of(block=np.array([row["block"]]), far=pa.array([far.tobytes()], pa.binary()))

    # A row per shard: bounded by the number of dimensions.
    rows = blocks.select("block", "shard", "part").join(F.broadcast(slices), "shard")
    return rows.mapInArrow(run, "block long, far binary")


def _assigned(blocks: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """(block, cluster, distance): partial distances added by block, the smallest one taken, ties to the smaller number."""

    def nearest(table: pa.Table) -> pa.Table:
        far = sum(_longs(x, -1, k) for x in table["far"].to_pylist())
        cluster = far.argmin(axis=1)
        distance = far[np.arange(len(far)), cluster]
        return pa.table({"block": table["block"].slice(0, 1), "cluster": pa.array([cluster.tobytes()], pa.binary()),
                         "distance": pa.array([distance.tobytes()], pa.binary())})

    return _partial(blocks, slices, k).groupBy("block").applyInArrow(nearest, "block long, cluster binary, distance binary")


def _updated(blocks: DataFrame, assigned: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """(shard, slice): every shard replaces its columns of the non-empty centroids by the floored means of their rows."""

    def sums(batches):
        total, count = {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                cluster = _longs(row["cluster"], -1)
                part = _longs(row["part"], len(cluster), -1)
                shard = row["shard"]
                np.add.at(total.setdefault(shard, np.zeros((k, part.shape[1]), np.int64)), cluster, part)
                count[shard] = count.get(shard, 0) + np.bincount(cluster, minlength=k)
        for shard, own in total.items():
            j, column = np.indices(own.shape)
            yield batch_of(shard=np.full(own.size, shard, np.int32), cluster=j.ravel().astype(np.int32),
                           column=column.ravel().astype(np.int32), total=own.ravel(), n=count[shard][j.ravel()])

    def update(table: pa.Table) -> pa.Table:
        new = _longs(table["slice"][0].as_py(), k, -1).copy()
        some = table.filter(pc.greater(table["n"], 0))
        new[some["cluster"].to_numpy(), some["column"].to_numpy()] = some["total"].to_numpy() // some["n"].to_numpy()
        return pa.table({"shard": table["shard"].slice(0, 1), "slice": pa.array([new.tobytes()], pa.binary())})

    rows = blocks.select("block", "shard", "part").join(assigned.select("block", "cluster"), "block")
    parts = rows.select("shard", "part", "cluster").mapInArrow(sums, "shard int, cluster int, column int, total long, n long")
    summed = parts.groupBy("shard", "cluster", "column").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return summed.join(F.broadcast(slices), "shard").groupBy("shard").applyInArrow(update, "shard int, slice binary")


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3,
            salt: str = "1:") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every kept vector after ``rounds`` rounds."""
    spark = df.sparkSession
    rows = materialize(whole_vectors(df, id_col, vec_col, dims), "whole")
    start = np.array(first_centroids(rows, k, salt), np.int64).reshape(-1, dims)
    n = len(start)
    blocks = materialize(_blocks(rows, dims), "blocks")
    slices = spark.createDataFrame(
        [(s, bytearray(np.ascontiguousarray(start[:, s * WIDTH:(s + 1) * WIDTH]).tobytes())) for s in range(-(-dims // WIDTH))],
        "shard int, slice binary")
    for _ in range(rounds if n else 0):
        assigned = materialize(_assigned(blocks, slices, n), "assigned")
        slices = materialize(_updated(blocks, assigned, slices, n), "slices")
    kind = rows.schema["id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>")
    assigned = materialize(_assigned(blocks, slices, n), "assigned")

    def each(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column("ids")[r].values
                yield batch_of(id=ids, cluster=_longs(batch.column("cluster")[r].as_py(), -1).astype(np.int32),
                               distance=_longs(batch.column("distance")[r].as_py(), -1).copy())

    heads = blocks.where("shard = 0").select("block", "ids")
    out = materialize(heads.join(assigned, "block").select("ids", "cluster", "distance")
                      .mapInArrow(each, f"id {kind}, cluster int, distance long"), "clustered")
    inertia = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    inertia = inertia.select("cluster", F.col("s").cast("bigint").alias("cluster_inertia"))
    # A row per centroid from here on: k times d numbers.
    whole = inertia.agg(F.sum(F.col("cluster_inertia").cast("decimal(38,0)")).cast("bigint")).first()[0]
    parts = sorted(slices.collect(), key=lambda r: r["shard"])
    final = np.concatenate([_longs(bytes(r["slice"]), n, -1) for r in parts], axis=1)
    centroids = spark.createDataFrame([(i, c) for i, c in enumerate(final.tolist())], "cluster int, centroid array<bigint>")
    return out.join(F.broadcast(inertia.join(centroids, "cluster")), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("bigint").alias("inertia"), "centroid")
