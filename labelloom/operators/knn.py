"""Exact k nearest neighbours by cosine distance, over tables of any size.

A side within a checked number of bytes travels to every task, which keeps the k
best of its own rows, so the larger side is not shuffled. Else both sides are cut
into blocks of bounded size, few enough that what travels grows with the input; a task compares one query block with one base block
by matrix products and emits only its k best per query, so no pair list exists. Pivots with radii skip base cells that cannot hold a
neighbour (triangle inequality on unit vectors), so the result stays exact.
Distances are rounded to 9 places and ties go to the smaller id. Rows without a
vector neither ask nor answer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labelloom import domain
from labelloom.functions.keys import order_digest
from labelloom.session import materialize, shuffle_width, spread, table_size

MAX_PIVOTS = 2048
MAX_GROUPS = 1000
SMALL_BYTES = 32 << 20  # a side up to this size is sent to every task
CELLS_AT_ONCE = 1 << 23  # products a task holds
SLICE = 4096  # base rows whose k-th best bounds the others
BLOCK_BYTES = 48 << 20  # of the vectors of a block, in double precision
ANSWER_BYTES = 40  # of an answer on its way, about
SLACK = 1e-6  # rounding of pivot distances


def unit_rows(column) -> np.ndarray:
    """Arrow list column to a matrix of unit-length double rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(n, -1) if n else flat.reshape(0, 0)
    norm = np.linalg.norm(m, axis=1, keepdims=True) if n else m
    return m / np.where(norm == 0, 1.0, norm) if n else m


def _pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (vectors @ pivots.T)))


def _candidates(sim: np.ndarray, least: np.ndarray):
    """(rows, cols, similarity) of the products of at least ``least`` per row; not a number never is."""
    at = np.flatnonzero(sim >= least[:, None])
    rows, cols = np.divmod(at, sim.shape[1])
    return rows, cols, sim.ravel()[at]


def _block_best(qm: np.ndarray, bm: np.ndarray, flat: np.ndarray, ids: np.ndarray, k: int, banned: np.ndarray | None):
    """(rows, cols, distance) of the k best per query row by (rounded distance, id).

    A single-precision product with ``flat`` (dimensions x base rows) finds the candidates: everything within its
    rounding error of the k-th best. Their distances are then taken in double. The k-th best of the first
    ``SLICE`` base rows is a bound for the slices that follow, so that only few products are looked at twice.
    """
    n, dim = bm.shape
    k = min(k, n)
    # Dot products of unit rows err by at most (dim + 2) * 2**-24 on either side.
    margin = np.float32(4 * (dim + 2) * 2.0**-24 + 4e-9)
    single, step = qm.astype(np.float32), max(SLICE, 8 * k)
    bound, found = None, []
    for lo in range(0, n, step):
        sim = single @ flat[:, lo:lo + step]
        if banned is not None:
            sim[banned[:, lo:lo + step]] = -np.inf
        if bound is None:
            width = sim.shape[1]
            bound = np.partition(sim, width - k, axis=1)[:, width - k] - margin
        rows, cols, near = _candidates(sim, bound)
        found.append((rows, cols + lo, near))
    rows, cols, near = (np.concatenate(x) for x in zip(*found))
    finite = np.isfinite(near)
    rows, cols, near = rows[finite], cols[finite], near[finite]
    if len(found) > 1:
        # The k-th best of all slices, where there are as many.
        order = np.lexsort((-near, rows))
        rows, cols, near = rows[order], cols[order], near[order]
        start = np.searchsorted(rows, np.arange(len(qm)))
        last = start + k - 1
        enough = last < np.append(start[1:], len(rows))
        least = np.full(len(qm), -np.inf, np.float32)
        least[enough] = near[last[enough]] - margin
        keep = near >= least[rows]
        rows, cols = rows[keep], cols[keep]
    # One formula whatever the number of candidates, in pieces, so that ties never depend on the plan.
    step = max(1, CELLS_AT_ONCE // max(1, dim))
    dot = np.concatenate([np.einsum("ij,ij->i", qm[rows[i:i + step]], bm[cols[i:i + step]])
                          for i in range(0, max(1, len(rows)), step)])
    dist = np.round(1.0 - dot, 9) + 0.0
    order = np.lexsort((ids[cols], dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], cols[keep], dist[keep]


def _compare(k: int, exclude: str | None, schema: pa.Schema, most: int = 512):
    def compare(queries: pa.Table, base: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or base.num_rows == 0:
            return schema.empty_table()
        chunk = max(1, min(most, CELLS_AT_ONCE // base.num_rows))
        qm, bm = unit_rows(queries["qvec"]), unit_rows(base["bvec"])
        flat = np.ascontiguousarray(bm.T, dtype=np.float32)
        ids = base["bid"].to_numpy()
        sides = {"id": ("qid", "bid"), "group": ("qgroup", "bgroup")}.get(exclude)
        mine, theirs = (queries[sides[0]].to_numpy(), base[sides[1]].to_numpy()) if sides else (None, None)
        parts = []
        for lo in range(0, queries.num_rows, chunk):
            banned = mine[lo : lo + chunk, None] == theirs[None, :] if sides else None
            rows, cols, dist = _block_best(qm[lo : lo + chunk], bm, flat, ids, k, banned)
            parts.append(pa.table([
                queries["qid"].take(pa.array(rows + lo)), base["bid"].take(pa.array(cols)),
                base["payload"].take(pa.array(cols)), pa.array(dist),
            ], schema=schema))
        return pa.concat_tables(parts)

    return compare


def _assign_cells(pivots: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            d = _pivot_distances(unit_rows(b.column("bvec")), pivots)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])],
                names=[*b.schema.names, "cell", "reach"],
            )

    return assign


def _nearest_of(base, k: int, exclude: str | None, schema: pa.Schema):
    """Queries as they come against a whole base."""
    compare = _compare(k, exclude, schema)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from compare(pa.Table.from_batches([b]), base.value).to_batches()

    return nearest


def _best_for(queries, k: int, exclude: str | None, schema: pa.Schema):
    """Base rows as they come against all queries; a task keeps the k best per query."""
    compare = _compare(k, exclude, schema)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = schema.empty_table()
        for b in batches:
            kept = pa.concat_tables([kept, compare(queries.value, pa.Table.from_batches([b]))])
            kept = kept.sort_by([("query_id", "ascending"), ("distance", "ascending"), ("base_id", "ascending")])
            if kept.num_rows:
                ids = kept["query_id"].to_numpy()
                start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                place = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
                kept = kept.filter(pa.array(place < k)).combine_chunks()
        yield from kept.to_batches()

    return best


@dataclass
class Cells:
    """What is known of the base cells: at most MAX_PIVOTS rows of figures."""

    pivots: np.ndarray
    pivot_groups: np.ndarray
    cells: list[int]
    near: np.ndarray  # smallest reach of a member per cell
    far: np.ndarray  # largest reach of a member per cell
    counts: np.ndarray  # cells x groups
    groups: list


def _kth_bound(dist: np.ndarray, usable: np.ndarray, need: int) -> np.ndarray:
    """Per row the smallest distance within which ``need`` usable members surely lie."""
    order = np.argsort(dist, axis=1)
    seen = np.cumsum(np.take_along_axis(np.broadcast_to(usable, dist.shape), order, axis=1), axis=1)
    enough = seen >= need
    at = enough.argmax(axis=1)
    bound = np.take_along_axis(dist, order, axis=1)[np.arange(len(at)), at]
    return np.where(enough.any(axis=1), bound, np.inf)


def _visit_cells(info: Cells, k: int, exclude: str | None):
    """Cells a query has to visit.

    Two upper bounds on the k-th distance: pivots are base rows themselves, and
    every member of a cell lies within distance + reach. A cell is skipped when
    its ring of reaches cannot come closer than the smaller bound.
    """
    need = k + 1 if exclude == "id" else k
    total = info.counts.sum(axis=1)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            every = _pivot_distances(unit_rows(b.column("qvec")), info.pivots)
            d = every[:, info.cells]
            members, single = np.broadcast_to(total, d.shape), np.ones(every.shape, dtype=np.int64)
            if exclude == "group":
                own = b.column("qgroup").to_numpy(zero_copy_only=False)
                where = {g: i for i, g in enumerate(info.groups)}
                lost = np.stack([info.counts[:, where[g]] if g in where else np.zeros_like(total) for g in own.tolist()])
                members = total - lost
                single = (own[:, None] != info.pivot_groups[None, :]).astype(np.int64)
            limit = np.minimum(_kth_bound(d + info.far, members, need), _kth_bound(every, single, need))
            least = np.maximum(d - info.far, info.near - d)
            # Compared as squares, where equal rounded distances differ by at most 2e-9.
            rows, cols = np.nonzero(np.maximum(least - SLACK, 0.0) ** 2 <= limit[:, None] ** 2 + 1e-8)
            taken = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(np.asarray(info.cells, dtype=np.int32)[cols])],
                names=[*b.schema.names, "cell"],
            )

    return visit


def _cells(b: DataFrame, wanted: int) -> tuple[DataFrame, Cells] | None:
    """Base rows with their nearest pivot, written once, and the figures per cell.

    At most MAX_PIVOTS vectors and MAX_PIVOTS x MAX_GROUPS counts reach the driver;
    with more groups there is no pruning.
    """
    if b.select("bgroup").distinct().limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
        return None
    seeds = b.orderBy(order_digest("bid", domain.SEED)).limit(wanted).select("bvec", "bgroup").toArrow()
    pivots = unit_rows(seeds["bvec"])
    schema = T.StructType([
        *b.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())])
    b = materialize(b.mapInArrow(_assign_cells(pivots), schema), "vector-cells")
    stats = b.groupBy("cell", "bgroup").agg(
        F.count("*").alias("n"), F.min("reach").alias("lo"), F.max("reach").alias("hi")).collect()
    cells, groups = sorted({s["cell"] for s in stats}), sorted({s["bgroup"] for s in stats})
    counts = np.zeros((len(cells), len(groups)), dtype=np.int64)
    lo, hi = np.full(len(cells), np.inf), np.zeros(len(cells))
    place, slot = {c: i for i, c in enumerate(cells)}, {g: i for i, g in enumerate(groups)}
    for s in stats:
        i = place[s["cell"]]
        counts[i, slot[s["bgroup"]]] = s["n"]
        lo[i], hi[i] = min(lo[i], s["lo"]), max(hi[i], s["hi"])
    return b.drop("reach"), Cells(pivots, seeds["bgroup"].to_numpy(), cells, lo, hi, counts, groups)


def _visited_share(q: DataFrame, visit, schema: T.StructType, sizes: dict, n_query: int, n_base: int) -> tuple[float, float]:
    """Share of the base rows and number of the cells a query visits, estimated on about 1,000 queries."""
    some = q.sample(False, min(1.0, 1000 / max(1, n_query)), domain.SEED)
    hits = some.mapInArrow(visit, schema).groupBy("cell").agg(F.count("*").alias("n")).collect()
    seen = max(1, some.count())
    return sum(sizes[h["cell"]] * h["n"] for h in hits) / (seen * n_base), sum(h["n"] for h in hits) / seen


def _grid(tasks: int, n_base: int, n_query: int, base_row: float, query_row: float, k: int, block_rows: int, query_rows: int) -> tuple[int, int]:
    """Blocks of the base and of the queries that are compared each with each.

    A base row travels once per block of queries, a query and its k answers once per block of the base. There are about
    ``tasks`` pairs of blocks, dealt so that least travels, whatever the number of rows: what is moved grows with the
    input, until ``BLOCK_BYTES`` bounds a block. ``block_rows`` and ``query_rows`` are the least blocks worth a task.
    """
    wide = tasks * max(1, n_base) * base_row / (max(1, n_query) * (query_row + ANSWER_BYTES * k))
    nb = min(ceil(n_base / block_rows), max(1, round(wide ** 0.5)), tasks)
    nq = min(ceil(n_query / query_rows), ceil(tasks / max(1, nb)))
    return max(1, nb, ceil(n_base * base_row / BLOCK_BYTES)), max(1, nq, ceil(n_query * query_row / BLOCK_BYTES))


def knn(
    query: DataFrame,
    base: DataFrame,
    k: int,
    *,
    qid: str = "vec_id",
    qvec: str = "embedding",
    bid: str = "vec_id",
    bvec: str = "embedding",
    payload: str | None = None,
    qgroup: str | None = None,
    bgroup: str | None = None,
    exclude: str | None = None,
    block_rows: int = 8192,
    query_rows: int = 8192,
    n_pivots: int | None = None,
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """(query_id, rank, base_id, payload, distance) of the k nearest base rows per query.

    ``exclude``: ``"id"`` leaves out the row with the query's own id,
    ``"group"`` leaves out base rows of the query's own group (folds). Both sides
    are scanned more than once: pass written tables where they are costly.
    """
    spark = query.sparkSession
    parts = max(shuffle_width(spark), spark.sparkContext.defaultParallelism)
    tasks = 4 * spark.sparkContext.defaultParallelism  # pairs of blocks; shuffle_width may grow with the input
    q = query.select(F.col(qid).alias("qid"), F.col(qvec).alias("qvec"),
                     (F.col(qgroup) if qgroup else F.lit(0)).cast("bigint").alias("qgroup"))
    b = base.select(F.col(bid).alias("bid"), F.col(bvec).alias("bvec"),
                    (F.col(bgroup) if bgroup else F.lit(0)).cast("bigint").alias("bgroup"),
                    (F.col(payload) if payload else F.lit(None).cast("int")).alias("payload"))
    q, b = q.where(F.col("qvec").isNotNull()), b.where(F.col("bvec").isNotNull())
    (n_base, base_bytes), (n_query, query_bytes) = table_size(b), table_size(q)
    out = T.StructType([
        T.StructField("query_id", q.schema["qid"].dataType), T.StructField("base_id", b.schema["bid"].dataType),
        T.StructField("payload", b.schema["payload"].dataType), T.StructField("distance", T.DoubleType()),
    ])
    order = W.partitionBy("query_id").orderBy("distance", "base_id")
    if n_pivots is None and (base_bytes if n_base <= n_query else query_bytes) <= small_bytes:
        sc = spark.sparkContext
        if n_base <= n_query:  # a checked number of bytes, as is the other case
            task = _nearest_of(sc.broadcast(b.toArrow()), k, exclude, to_arrow_schema(out))
            pairs = spread(q, "qid").mapInArrow(task, out)
        else:
            task = _best_for(sc.broadcast(q.toArrow()), k, exclude, to_arrow_schema(out))
            pairs = spread(b, "bid").mapInArrow(task, out)
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
            .select("query_id", "rank", "base_id", "payload", "distance")
    wanted = min(MAX_PIVOTS, n_pivots or (ceil(2 * n_base / block_rows) if n_base > 4 * block_rows else 1))
    info = _cells(b, wanted) if wanted > 1 else None
    if info is not None:
        b, figures = info
        visit = _visit_cells(figures, k, exclude)
        schema = T.StructType([*q.schema.fields, T.StructField("cell", T.IntegerType())])
        sizes = dict(zip(figures.cells, figures.counts.sum(axis=1).tolist()))
        # Pivots pay off only if queries skip most rows; a sample of queries tells, results are not sampled.
        # A visit is a copy of the query, so they must not be many more than the blocks of a plain comparison.
        share, copies = (0.0, 0.0) if n_pivots else _visited_share(q, visit, schema, sizes, n_query, n_base)
        worth = share < 0.25 and copies <= 2 * ceil(tasks ** 0.5)
        if worth:
            q = materialize(q.mapInArrow(visit, schema), "vector-visits")
            visits = {r["cell"]: r["n"] for r in q.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        else:
            info, b = None, b.drop("cell")
    if info is None:
        b, q = b.withColumn("cell", F.lit(0)), q.withColumn("cell", F.lit(0))
        visits, sizes = {0: n_query}, {0: n_base}

    # Cells above the block size are split by id hash on both sides.
    base_row, query_row = base_bytes / max(1, n_base), query_bytes / max(1, n_query)
    least = min(query_rows, 256) if len(sizes) == 1 else query_rows
    plan = [(c, *_grid(ceil(tasks / len(visits)), sizes[c], n, base_row, query_row, k, block_rows, least)) for c, n in visits.items()]
    if len(plan) == 1:
        nb_col, nq_col = F.lit(plan[0][1]), F.lit(plan[0][2])
        b = b.where(F.col("cell") == plan[0][0])
    else:
        table = F.broadcast(spark.createDataFrame(plan, "cell int, nb int, nq int"))  # at most MAX_PIVOTS rows
        q, b = q.join(table, "cell"), b.join(table, "cell")
        nb_col, nq_col = F.col("nb"), F.col("nq")
    q = q.withColumn("qpart", F.pmod(F.hash("qid"), nq_col)) \
        .withColumn("bpart", F.explode(F.sequence(F.lit(0), nb_col - 1))).drop("nb", "nq")
    b = b.withColumn("bpart", F.pmod(F.hash("bid"), nb_col)) \
        .withColumn("qpart", F.explode(F.sequence(F.lit(0), nq_col - 1))).drop("nb", "nq")
    keys = ["cell", "bpart", "qpart"]
    # A few partitions per group even out the hash, without tasks that get no group.
    groups = sum(nb * nq for _, nb, nq in plan) or 1
    parts = min(max(parts, 2 * groups), 4 * groups)
    pairs = (
        q.repartition(parts, *keys).groupBy(*keys)
        .cogroup(b.repartition(parts, *keys).groupBy(*keys))
        .applyInArrow(_compare(k, exclude, to_arrow_schema(out)), out)
    )
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "base_id", "payload", "distance")


def knn_vote(neighbours: DataFrame, weight: str | None = None) -> DataFrame:
    """Majority label per query; ties go to the label whose nearest member ranks first."""
    n = F.sum(weight) if weight else F.count("*")
    votes = neighbours.groupBy("query_id", "payload").agg(n.alias("votes"), F.min("rank").alias("first_rank"))
    pick = F.max_by("payload", F.struct("votes", (-F.col("first_rank")).alias("r")))
    return votes.groupBy("query_id").agg(pick.alias("pred_label"), F.max("votes").alias("votes"))


def knn_scores(neighbours: DataFrame, labels: list) -> DataFrame:
    """Smoothed vote share (votes + 1) / (k + classes) for every label of the closed list."""
    found = neighbours.where(F.col("payload").isin(list(labels))) \
        .groupBy("query_id").agg(F.collect_list("payload").alias("found"))
    shares = F.transform(F.array(*[F.lit(l) for l in labels]), lambda l: F.struct(
        l.alias("label"),
        ((F.size(F.filter("found", lambda x: x == l)) + 1) / (F.size("found") + len(labels))).alias("score")))
    return found.select("query_id", F.inline(shares))


def bootstrap_votes(labels: list, drawn: np.ndarray, own: np.ndarray, k: int):
    """(label index or -1 per iteration, iterations whose list was too short) for one query.

    ``drawn`` is neighbours x iterations, nearest first: each neighbour counts as often as it was drawn, up to ``k``
    copies in all. Iterations that drew the query itself (``own``) are no test of it. Ties go to the label
    whose nearest copy comes first.
    """
    before = np.cumsum(drawn, axis=0) - drawn
    copies = np.minimum(drawn, np.maximum(k - before, 0))
    places = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    votes, first = np.zeros((len(places), drawn.shape[1]), np.int64), np.full((len(places), drawn.shape[1]), len(labels))
    for rank, label in enumerate(labels):
        i = places[label]
        votes[i] += copies[rank]
        first[i] = np.where((copies[rank] > 0) & (first[i] == len(labels)), rank, first[i])
    best = (votes * (len(labels) + 1) - first).argmax(axis=0)
    told = (own == 0) & (copies.sum(axis=0) > 0)
    return np.where(told, best, -1), (own == 0) & (copies.sum(axis=0) < k)


def knn_bootstrap(base: DataFrame, boot: DataFrame, k: int, payload: str, vec_id: str = "vec_id",
                  n_rows: int | None = None, start: int | None = None) -> DataFrame:
    """Confusion counts (iteration, true_label, pred_label, n) of the out-of-bag rows of every iteration.

    ``boot`` has (vec_id, draws), see ``split.bootstrap``. One neighbour list serves all iterations: a query meets the draws
    of its neighbours once, votes in all iterations at once and leaves counts only. When a list runs out before ``k``
    copies are found its length is doubled, so the vote is exact.
    """
    n_rows = n_rows or base.count()
    m = min(n_rows - 1, start or 8 * k)
    kind = base.schema[payload].dataType
    boot = materialize(boot.select(F.col(vec_id).alias("base_id"), "draws"), "bootstrap")
    own = base.select(F.col(vec_id).alias("query_id"), F.col(payload).alias("true_label")) \
        .join(boot.withColumnRenamed("base_id", "query_id").withColumnRenamed("draws", "own"), "query_id")

    def vote(batches):
        counts, short = Counter(), 0
        for batch in batches:
            for true, mine, found in zip(*[batch.column(c).to_pylist() for c in ("true_label", "own", "found")]):
                labels = list(dict.fromkeys(f["payload"] for f in found))
                drawn = np.stack([np.frombuffer(f["draws"], np.uint8) for f in found]).astype(np.int64)
                best, few = bootstrap_votes([f["payload"] for f in found], drawn, np.frombuffer(mine, np.uint8), k)
                short += int(few.sum())
                for it in np.flatnonzero(best >= 0).tolist():
                    counts[it, true, labels[best[it]]] += 1
        rows = [(*cell, n) for cell, n in counts.items()] + ([(-1, None, None, short)] if short else [])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    schema = T.StructType([T.StructField("iteration", T.LongType()), T.StructField("true_label", kind),
                           T.StructField("pred_label", kind), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)
    while True:
        near = knn(base, base, m, qid=vec_id, bid=vec_id, payload=payload, exclude="id").join(boot, "base_id")
        lists = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "payload", "draws"))).alias("found"))
        each = lists.join(own, "query_id").select("true_label", "own", "found").mapInArrow(vote, schema)
        votes = materialize(each.groupBy("iteration", "true_label", "pred_label").agg(F.sum("n").alias("n")), "boot-votes")
        if m >= n_rows - 1 or votes.where("iteration < 0").isEmpty():
            return votes.where("iteration >= 0")
        m = min(n_rows - 1, 2 * m)


def search(store: DataFrame, vectors: DataFrame, n: int, metadata: list[str], vec_id: str = "vec_id") -> DataFrame:
    """Top-n stored records per query vector with their metadata columns."""
    near = knn(vectors, store, n, qid=vec_id, bid=vec_id)
    return near.drop("payload").join(store.select(F.col(vec_id).alias("base_id"), *metadata), "base_id")
