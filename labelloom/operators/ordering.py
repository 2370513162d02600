"""Exact ranks, running totals and neighbours inside groups of any size.

A plain window partitioned by a label or a series puts a whole group into one
task. Here the group is first cut into ordered buckets. Windows run per
(group, bucket), and one small table with a row per (group, bucket) carries the
offsets across bucket borders. Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.functions.keys import order_digest
from labelloom.session import checked_broadcast, materialize, shuffle_width

BUCKET = "__bucket"


def order_buckets(df: DataFrame, order_col: str, n_buckets: int | None = None) -> DataFrame:
    """Add a bucket number that grows with ``order_col`` and holds about 1/n of the rows.

    Borders are quantiles of the data, so a dense stretch gets more buckets. Those of
    text come from a bounded sample of its distinct values.
    """
    n = n_buckets or shuffle_width(df.sparkSession)
    if dict(df.dtypes)[order_col] == "string":
        distinct = df.select(F.col(order_col).alias("x")).where("x is not null").distinct()
        sample = sorted(r["x"] for r in distinct.orderBy(F.xxhash64("x")).limit(32 * n).collect())
        borders = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
        passed = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b <= F.col(order_col))) if borders else F.lit(0)
        return df.withColumn(BUCKET, F.coalesce(passed, F.lit(0)).cast("double"))
    probs = [i / n for i in range(1, n)]
    edges = df.stat.approxQuantile(order_col, probs, 1.0 / (4 * n)) if n > 1 else []
    edges = sorted(set(edges or []))
    splits = [float("-inf"), *edges, float("inf")]
    if len(splits) < 3:
        return df.withColumn(BUCKET, F.lit(0.0))
    as_double = "__order_double"
    df = df.withColumn(as_double, F.col(order_col).cast("double"))
    out = Bucketizer(splits=splits, inputCol=as_double, outputCol=BUCKET, handleInvalid="keep")
    return out.transform(df).drop(as_double)


def _keyed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Non-null helper keys for ``by``, so null groups survive a plain equi-join.

    Windows and the border join use the same keys: rows move once.
    """
    types, keys = dict(df.dtypes), []
    for i, c in enumerate(by):
        kind = types[c]
        numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double")
        value = F.coalesce(F.col(c), F.lit(0).cast(kind)) if numeric else F.coalesce(F.col(c).cast("string"), F.lit(""))
        df = df.withColumns({f"__k{i}": value, f"__n{i}": F.col(c).isNull()})
        keys += [f"__k{i}", f"__n{i}"]
    return df, keys


def running_totals(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    values: dict[str, Column],
    group_totals: bool = False,
) -> DataFrame:
    """Inclusive running sums per group over a frame that carries ``BUCKET``.

    ``values`` maps an output name to the summed expression. ``BUCKET`` must be
    ordered like ``order`` (use a negated bucket for descending orders). With
    ``group_totals`` the column ``<name>_total`` holds the sum of the group.
    """
    df, keys = _keyed(df, by)
    part = [*keys, BUCKET]
    for name, expr in values.items():
        df = df.withColumn(f"__v_{name}", expr)
    sums = df.groupBy(*part).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    across = W.partitionBy(*keys).orderBy(BUCKET)
    before = across.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    sums = sums.select(
        *part,
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in values],
        *([F.sum(f"__s_{n}").over(whole).alias(f"{n}_total") for n in values] if group_totals else []),
    )
    local = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    for n in values:
        df = df.withColumn(f"__l_{n}", F.sum(f"__v_{n}").over(local))
    out = df.join(sums, part, "left")
    for n in values:
        out = out.withColumn(n, F.col(f"__l_{n}") + F.col(f"__o_{n}"))
    return out.drop(*keys, *[f"__{p}_{n}" for n in values for p in "vlo"])


def seeded_rank(
    df: DataFrame,
    by: list[str],
    key: str,
    seed: int,
    rank_col: str = "rank",
    digits: int = 3,
) -> DataFrame:
    """Exact 1-based rank per group in seeded shuffle order, plus ``<rank_col>_total``.

    Buckets are the first ``digits`` hex digits of the digest (16**digits of
    them), which are even by construction.
    """
    digest = "__digest"
    df = df.withColumn(digest, order_digest(key, seed))
    df = df.withColumn(BUCKET, F.substring(digest, 1, digits))
    out = running_totals(
        df, by, [F.col(digest), F.col(key)], {rank_col: F.lit(1).cast("bigint")}, group_totals=True
    )
    return out.drop(BUCKET, digest)


def seeded_take(
    df: DataFrame,
    by: list[str],
    key: str,
    seed: int,
    size: Callable[[Column], Column],
    out: str = "taken",
    digits: int = 3,
) -> DataFrame:
    """Flag the first ``size(total)`` rows per group in seeded shuffle order.

    Counts per digest prefix tell in which prefix a group is cut; only the rows
    of that prefix (one in 16**digits) are ranked, which gives one threshold per
    group. The full rows are then flagged by a comparison: they are never
    shuffled or sorted.
    """
    df, keys = _keyed(df, by)
    digest = order_digest(key, seed)
    base = df.select(*keys, F.col(key).alias("__key"), digest.alias("__digest")) \
        .withColumn(BUCKET, F.substring("__digest", 1, digits))
    counts = base.groupBy(*keys, BUCKET).agg(F.count("*").alias("n"))
    group = W.partitionBy(*keys)
    counts = counts.withColumn("upto", F.sum("n").over(group.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, 0))) \
        .withColumn("size", size(F.sum("n").over(group)).cast("bigint"))
    before = F.col("upto") - F.col("n")
    cuts = counts.where((before < F.col("size")) & (F.col("size") <= F.col("upto"))) \
        .select(*keys, BUCKET, (F.col("size") - before).alias("need"))
    edge = base.join(checked_broadcast(materialize(cuts, "cuts")), [*keys, BUCKET])
    place = F.row_number().over(group.orderBy("__digest", "__key"))
    last = edge.withColumn("place", place).where(F.col("place") == F.col("need")) \
        .select(*keys, F.struct("__digest", "__key").alias("__last"))
    mine = F.struct(digest.alias("d"), F.col(key).alias("k"))
    if not keys:
        row = last.first()
        if row is None:
            return df.withColumn(out, F.lit(False))
        bound = F.struct(F.lit(row["__last"][0]).alias("d"), F.lit(row["__last"][1]).cast(df.schema[key].dataType).alias("k"))
        return df.withColumn(out, mine <= bound)
    flagged = df.join(checked_broadcast(materialize(last, "thresholds")), keys, "left")
    return flagged.withColumn(out, F.coalesce(mine <= F.col("__last"), F.lit(False))).drop(*keys, "__last")


def position_rank(
    df: DataFrame, by: list[str], order_col: str, tie: list[str] | None = None, rank_col: str = "rank"
) -> DataFrame:
    """Exact 1-based rank per group in the order of a numeric column."""
    df = order_buckets(df, order_col)
    order = [F.col(order_col), *[F.col(t) for t in tie or []]]
    out = running_totals(df, by, order, {rank_col: F.lit(1).cast("bigint")}, group_totals=True)
    return out.drop(BUCKET)


def neighbour(
    df: DataFrame,
    by: list[str],
    order: list[str],
    payload: dict[str, Column],
    previous: bool = True,
    strict: bool = True,
) -> DataFrame:
    """Nearest earlier (or later) row with a non-null payload, per group.

    ``payload`` maps output names to expressions; a row takes part as a source
    when the first expression is not null. ``strict`` leaves the row itself out.
    The frame must carry ``BUCKET`` ordered like ``order``.
    """
    df, keys = _keyed(df, by)
    part = [*keys, BUCKET]
    names = list(payload)
    side = "p" if previous else "n"
    src, got = f"__src_{side}", f"__got_{side}"
    first = payload[names[0]]
    df = df.withColumn(src, F.when(first.isNotNull(), F.struct(*[e.alias(n) for n, e in payload.items()])))
    # Later rows are reached by a descending sort, so both frames only grow.
    turn = F.asc if previous else F.desc
    local = W.partitionBy(*part).orderBy(*[turn(o) for o in order])
    frame = local.rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    df = df.withColumn(got, F.last(src, ignorenulls=True).over(frame))
    rank = F.struct(*[F.col(o) for o in order])
    keep = F.when(F.col(src).isNotNull(), rank)
    pick = F.max_by(src, keep) if previous else F.min_by(src, keep)
    borders = df.groupBy(*part).agg(pick.alias("__edge"))
    across = W.partitionBy(*keys).orderBy(turn(BUCKET)).rowsBetween(W.unboundedPreceding, -1)
    carry = F.last("__edge", ignorenulls=True).over(across)
    borders = borders.select(*part, carry.alias("__carry"))
    out = df.join(borders, part, "left")
    best = F.coalesce(F.col(got), F.col("__carry"))
    for n in names:
        out = out.withColumn(n, best[n])
    return out.drop(*keys, src, got, "__carry")
