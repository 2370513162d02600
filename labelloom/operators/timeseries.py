"""Resource series: roll-up, power, energy, resampling, interpolation and smoothing.

Input is (series, t, values...) with ``t`` in microseconds. A series may hold a
large share of all rows: ordered work runs per (series, time bucket) and only
bucket borders are carried over (see ``ordering``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.ordering import BUCKET, neighbour, order_buckets, position_rank
from labelloom.session import checked_broadcast

SECOND = 1_000_000


def tick_rollup(df: DataFrame, series: str, tick: str, cores: int, cpu: str = "cpu_percent", ram: str = "ram_mb") -> DataFrame:
    """Sum CPU and memory over all processes of a tick; CPU also divided by the cores."""
    return df.groupBy(series, tick).agg(
        F.sum(cpu).alias("cpu_percent_raw"), (F.sum(cpu) / cores).alias("cpu_percent_normalized"),
        F.sum(ram).alias("ram_mb"), F.count("*").alias("n_processes"),
    )


def power(cpu: Column, tdp: float, base: float, gpu_watts: Column | None = None) -> Column:
    """base + min(1, cpu/100) * (tdp - base), plus GPU watts."""
    share = F.when(cpu > 100.0, 1.0).otherwise(cpu / 100.0)
    watts = F.lit(base) + share * F.lit(tdp - base)
    return watts if gpu_watts is None else watts + gpu_watts


def with_previous(df: DataFrame, series: str, t: str, tie: str) -> DataFrame:
    """Add ``prev_t``, the time of the sample before, per series."""
    df = order_buckets(df, t)
    return neighbour(df, [series], [t, tie], {"prev_t": F.col(t)}).drop(BUCKET)


def energy(df: DataFrame, series: str, t: str, tie: str, watts: str = "watts") -> DataFrame:
    """Watt-hours per series: each sample times the time since the sample before."""
    rows = with_previous(df.select(series, t, tie, watts), series, t, tie)
    step = (F.col(t) - F.coalesce("prev_t", F.col(t))) / SECOND / 3600
    return rows.groupBy(series).agg(F.sum(F.col(watts) * step).alias("energy_wh"), F.count("*").alias("n_samples"))


def run_summary(df: DataFrame, series: str, t: str, tie: str) -> DataFrame:
    """Runtime, sample count, mean CPU, peak RAM, mean watts and energy per series."""
    rows = with_previous(df, series, t, tie)
    step = (F.col(t) - F.coalesce("prev_t", F.col(t))) / SECOND / 3600
    return rows.groupBy(series).agg(
        F.round((F.max(t) - F.min(t)) / SECOND, 2).alias("total_runtime_seconds"),
        F.count("*").alias("n_samples"),
        F.round(F.avg("cpu_percent"), 2).alias("average_cpu_percent"),
        F.max("ram_mb").alias("peak_ram_mb"),
        F.round(F.avg("watts"), 2).alias("average_watts"),
        F.round(F.sum(F.col("watts") * step), 6).alias("estimated_total_energy_wh"),
    )


def _with_span(df: DataFrame, series: str, t: str) -> DataFrame:
    span = df.groupBy(series).agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    return df.join(checked_broadcast(span), series)


def resample(df: DataFrame, series: str, t: str, tie: str, values: list[str], step: int, fill: bool = True) -> DataFrame:
    """Regular grid from the first sample in steps of ``step`` microseconds.

    A cell [g, g + step) holds the mean of its samples. With ``fill`` an empty
    cell gets the straight line between the samples around the grid time, and the
    last grid point the last value. A series shorter than one step is returned
    as it came. Columns: series, cell, t, values, n_samples (0 = filled).
    """
    df = df.select(series, t, tie, *values)
    rows = _with_span(order_buckets(df, t) if fill else df, series, t)
    rows = rows.withColumn("cell", F.floor((F.col(t) - F.col("t0")) / step).cast("bigint"))
    short = F.col("t1") - F.col("t0") < step
    # In a short series every sample is a group of its own.
    solo = F.when(short, F.struct(t, tie))
    out = rows.groupBy(series, "cell", solo.alias("solo")).agg(
        F.min("t0").alias("t0"), *[F.avg(v).alias(v) for v in values], F.count("*").alias("n_samples")
    ).select(
        series, "cell", F.coalesce(F.col(f"solo.{t}"), F.col("t0") + F.col("cell") * step).alias(t), *values, "n_samples"
    )
    if not fill:
        return out
    return out.unionByName(_gaps(rows.where(~short), series, t, tie, values, step))


def _gaps(rows: DataFrame, series: str, t: str, tie: str, values: list[str], step: int, run: int = 10_000) -> DataFrame:
    """Empty cells, read off each pair of neighbouring samples (rows carry BUCKET)."""
    nxt = {"n_t": F.col(t), **{f"n_{v}": F.col(v) for v in values}}
    rows = neighbour(rows, [series], [t, tie], nxt, previous=False).drop(BUCKET)
    last_cell = F.ceil((F.col("t1") - F.col("t0")) / step)
    until = F.coalesce(F.floor((F.col("n_t") - F.col("t0")) / step) - 1, last_cell)
    gaps = rows.withColumn("until", until.cast("bigint")).where(F.col("until") > F.col("cell"))
    # A long gap is cut into runs that spread over tasks before cells are made.
    gaps = gaps.withColumn("start", F.explode(F.sequence(F.col("cell") + 1, F.col("until"), F.lit(run).cast("bigint"))))
    gaps = gaps.repartition(series, "start")
    gaps = gaps.withColumn("cell", F.explode(F.sequence("start", F.least("until", F.col("start") + run - 1))))
    grid = F.col("t0") + F.col("cell") * step
    share = (grid - F.col(t)) / (F.col("n_t") - F.col(t))
    lines = [
        F.when(F.col("n_t").isNull(), F.col(v))
        .otherwise(F.col(v) + (F.col(f"n_{v}") - F.col(v)) * share).cast("double").alias(v)
        for v in values
    ]
    return gaps.select(series, "cell", grid.alias(t), *lines, F.lit(0).cast("bigint").alias("n_samples"))


def smooth(df: DataFrame, series: str, t: str, tie: str, value: str, window: int = 3) -> DataFrame:
    """Centred moving mean; edges repeat the end value, shorter series stay unchanged.

    Every sample sends its weight to the positions it takes part in, so the sum
    is a plain aggregation and no frame crosses a bucket border.
    """
    h = window // 2
    rows = position_rank(df.select(series, t, tie, value), [series], t, [tie], "pos")
    i, n = F.col("pos"), F.col("pos_total")
    if window <= 1:
        return rows.select(series, "pos", t, F.col(value).cast("double").alias("smoothed"))
    reach = F.sequence(F.greatest(F.lit(1).cast("bigint"), i - h), F.least(n, i + h))
    at = F.when(n < window, F.array(i)).otherwise(reach)
    sent = rows.withColumn("at", F.explode(at))
    p = F.col("at")
    weight = (
        F.lit(1)
        + F.when(i == 1, F.greatest(F.lit(0), F.lit(h) - p + 1)).otherwise(0)
        + F.when(i == n, F.greatest(F.lit(0), p + h - n)).otherwise(0)
    )
    share = F.when(n < window, F.lit(1.0)).otherwise(weight / F.lit(float(window)))
    return sent.groupBy(series, F.col("at").alias("pos")).agg(
        F.max(F.when(i == p, F.col(t))).alias(t),
        # A missing sample leaves no number for the positions it takes part in.
        F.when(F.count(value) == F.count("*"), F.sum(F.col(value) * share)).alias("smoothed")
    )


def peaks(df: DataFrame, series: str, t: str, value: str) -> DataFrame:
    """Peak and mean per series and the first time the peak is reached."""
    return df.groupBy(series).agg(
        F.max(value).alias("peak"), F.max_by(F.col(t), F.struct(F.col(value), -F.col(t))).alias("peak_t"),
        F.avg(value).alias("mean"),
    )
