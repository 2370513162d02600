"""Deterministic splits, folds and resamples keyed by row, not by position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom import domain
from labelloom.functions import text as tx
from labelloom.functions.keys import draw, order_digest
from labelloom.operators.ordering import seeded_rank, seeded_take
from labelloom.session import bounded_values


def holdout(df: DataFrame, label: str, key: str, fraction: float = domain.TEST_FRACTION,
            seed: int = domain.SEED) -> DataFrame:
    """Add ``split``: per label exactly round(n * fraction) rows are test."""
    out = seeded_take(df, [label], key, seed, lambda total: F.round(total * F.lit(fraction)), "__test")
    return out.withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def kfold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = domain.SEED) -> DataFrame:
    """Add ``fold`` (0..k-1); the first fold rotates with the label's place in label order."""
    ranked = seeded_rank(df, [label], key, seed, "__rank")
    # Labels are a closed list, so their places enter as literals.
    places = [F.lit(x) for i, value in enumerate(bounded_values(df, label)) for x in (value, i)]
    first = F.coalesce(F.element_at(F.create_map(*places), F.col(label)), F.lit(0)) if places else F.lit(0)
    out = ranked.withColumn("fold", ((F.col("__rank") - 1 + first) % k).cast("int"))
    return out.drop("__rank", "__rank_total")


POSITIONS = 4096  # rows whose draws are added up together


def bootstrap(df: DataFrame, key: str, iterations: int, seed: int = domain.SEED) -> DataFrame:
    """(key, draws): one byte per iteration, how often the row was drawn in it; 0 marks an out-of-bag row.

    Every iteration draws as many rows as there are, with replacement. A row's position is its exact seeded rank over the
    whole table. Draws travel packed by block of positions, so no row per row and iteration is ever made.
    """
    n = df.count()
    pos = seeded_rank(df.select(key), [], key, seed, "pos").select(key, "pos")
    name = lambda i: F.concat_ws("-", i.cast("string"), F.col("id").cast("string"))
    slots = df.sparkSession.range(n).select(F.transform(
        F.sequence(F.lit(0), F.lit(iterations - 1)), lambda i: draw(name(i), f"boot{seed}") % n).alias("at"))

    def deal(batches):
        for batch in batches:
            at = batch.column(0).flatten().to_numpy()
            event = at % POSITIONS * iterations + np.tile(np.arange(iterations), batch.num_rows)
            order = np.argsort(at // POSITIONS, kind="stable")
            block, event = (at // POSITIONS)[order], event[order].astype(np.int32)
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[first], pa.int64()), pa.array([e.tobytes() for e in np.split(event, first[1:])], pa.binary())], ["block", "events"])

    def add(batches):
        block, seen = None, None
        for batch in batches:
            for b, events in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != block:
                    if block is not None:
                        yield packed(block, seen)
                    block, seen = b, np.zeros(POSITIONS * iterations, np.int64)
                seen += np.bincount(np.frombuffer(events, np.int32), minlength=len(seen))
        if block is not None:
            yield packed(block, seen)

    def packed(block, seen):
        if seen.max() > 255:
            raise OverflowError("a row was drawn more than 255 times in one iteration")
        raw = seen.astype(np.uint8).tobytes()
        rows = min(POSITIONS, n - block * POSITIONS)
        return pa.RecordBatch.from_arrays([
            pa.array(block * POSITIONS + 1 + np.arange(rows), pa.int64()),
            pa.array([raw[i * iterations:(i + 1) * iterations] for i in range(rows)], pa.binary())], ["pos", "draws"])

    drawn = slots.mapInArrow(deal, "block long, events binary").repartition("block").sortWithinPartitions("block") \
        .mapInArrow(add, "pos long, draws binary")
    return pos.join(drawn, "pos", "left").select(key, F.coalesce("draws", F.lit(bytes(iterations))).alias("draws"))


def bootstrap_sizes(boot: DataFrame, min_oob: int = 2) -> DataFrame:
    """Distinct training rows and out-of-bag rows per iteration; tiny test sets are skipped."""
    def run(batches):
        sums = 0
        for batch in batches:
            rows = [np.frombuffer(x, np.uint8) for x in batch.column(0).to_pylist()]
            for i in range(0, len(rows), 4096):
                m = np.stack(rows[i:i + 4096])
                sums = sums + np.stack([(m > 0).sum(axis=0), (m == 0).sum(axis=0), m.sum(axis=0, dtype=np.int64)])
        if not isinstance(sums, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.shape[1])), *map(pa.array, sums)], ["iteration", "n_train", "n_oob", "n_draws"])

    each = boot.select("draws").mapInArrow(run, "iteration long, n_train long, n_oob long, n_draws long")
    return each.groupBy("iteration").agg(*[F.sum(c).alias(c) for c in ("n_train", "n_oob", "n_draws")]).where(F.col("n_oob") >= min_oob)


def sample_to(df: DataFrame, key: str, n: int, seed: int = domain.SEED) -> DataFrame:
    """``n`` rows: without replacement when there are enough, else drawn with replacement.

    Adds ``copies``, the number of times a row is taken; explode it to get rows.
    """
    have = df.count()
    if n <= have:
        picked = seeded_take(df, [], key, seed, lambda total: F.least(total, F.lit(n)), "__taken")
        return picked.where("__taken").drop("__taken").withColumn("copies", F.lit(1).cast("bigint"))
    boot = seeded_rank(df, [], key, seed, "pos").drop("pos_total")
    if not have:  # nothing to draw from
        return df.withColumn("copies", F.lit(1).cast("bigint"))
    ids = df.sparkSession.range(n)
    taken = ids.select((draw("id", f"fill{seed}") % have + 1).alias("pos")) \
        .groupBy("pos").agg(F.count("*").alias("copies"))
    return boot.join(taken, "pos").drop("pos")


def few_shot(df: DataFrame, labels: list[str], key: str, text: str, label: str, per_class: int = 1,
             max_total: int | None = None, seed: int = domain.SEED, low: int = 50, high: int = 500,
             min_chars: int = 10) -> DataFrame:
    """Numbered examples: ``per_class`` rows of each label, texts in the length band first.

    Walks labels in list order until ``max_total`` examples exist (default: one
    pass over all labels), then shuffles. The rank filter limits each label
    inside every map task before the shuffle, so a dominant label is cheap.
    """
    max_total = max_total or per_class * len(labels)
    body = tx.normalize_body(text)
    body = tx.truncate_words(body)
    order = F.create_map(*[F.lit(x) for i, l in enumerate(labels) for x in (l, i)])
    rows = df.select(
        F.col(key), F.col(label).alias("label"), body.alias("body"), F.element_at(order, F.col(label)).alias("label_ord")
    ).where(F.col("label_ord").isNotNull() & (F.length("body") > min_chars))
    rows = rows.withColumn("in_band", F.length("body").between(low, high).cast("int"))
    rows = rows.withColumn("digest", order_digest(key, seed))
    pick = W.partitionBy("label").orderBy(F.desc("in_band"), "digest")
    top = rows.withColumn("rn", F.row_number().over(pick)).where(F.col("rn") <= per_class)
    top = top.withColumn("best", F.max("in_band").over(W.partitionBy("label"))).where("in_band = best")
    # At most per_class rows per label of a closed list are left here.
    walk = W.orderBy("label_ord", "rn")
    top = top.withColumn("n", F.row_number().over(walk))
    before = F.min("n").over(W.partitionBy("label_ord"))
    top = top.withColumn("start", before).where(F.col("start") <= max_total)
    example = tx.truncate_words("body", domain.MAX_EXAMPLE_CHARS, domain.EXAMPLE_MARKER)
    shuffled = F.row_number().over(W.orderBy(F.md5(F.concat("digest", F.lit("|shuffle")))))
    out = top.select(shuffled.alias("example_no"), key, "label", example.alias("example"))
    return out.where(F.col("example_no") <= max_total)


# The text form of a numbered example and the line between two.
EXAMPLE_FORM = "Ejemplo %d:\nTexto del correo:\n%s\n\nEtiqueta correcta:\n%s"
EXAMPLE_BREAK = "\n\n---\n\n"


def few_shot_block(examples: DataFrame) -> DataFrame:
    """One text block of the numbered examples."""
    block = F.format_string(EXAMPLE_FORM, "example_no", "example", "label")
    rows = examples.select(F.struct("example_no", block.alias("block")).alias("e"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["block"]),
                                 EXAMPLE_BREAK).alias("examples"))
