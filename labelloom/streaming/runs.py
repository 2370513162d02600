"""Run summaries of series from the stream alone, by keyed state and event-time timers.

Two stateful steps follow each other. Windows of ``piece`` width reduce the samples of a series to one row per piece,
which spreads a series with very many samples over tasks and keeps only the samples of open pieces. The keyed step holds
a few running sums per series, adds the pieces in order and closes a run when a pause of ``gap`` has passed: either
the next piece shows it, or a timer does once the watermark is so far that no piece can come before the pause ends.

Defined results: samples of one instant count in the order of ``tie``; null readings are left out of sums, means and peaks and
add no energy; rows without a time are not read; rows behind the watermark are dropped and counted, once per task and piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from labelloom.streaming.series import watermarked

STATE = "first_t long, last_t long, n long, cpu double, n_cpu long, ram double, watts double, n_watts long, wh double"
HOUR = 3_600_000_000


def run_pieces(stream: DataFrame, series: str, ts: str, tie: str, piece: str, lateness: str) -> DataFrame:
    """Samples of a series reduced to one row per piece of time: span, counts, sums, peak and inner energy."""
    sample = F.struct("t", tie, F.col("watts").cast("double").alias("w"))
    rows = watermarked(stream, ts, lateness).withColumn("t", F.unix_micros(ts))
    pieces = rows.groupBy(series, F.window(ts, piece).alias("w")).agg(
        F.sort_array(F.collect_list(sample)).alias("s"), F.count("*").alias("n"),
        F.sum(F.col("cpu_percent").cast("double")).alias("cpu"), F.count("cpu_percent").alias("n_cpu"),
        F.max(F.col("ram_mb").cast("double")).alias("ram"),
        F.sum(F.col("watts").cast("double")).alias("watts"), F.count("watts").alias("n_watts"),
    )
    inner = F.expr(
        "aggregate(slice(s, 2, size(s)), named_struct('e', 0.0D, 't', s[0].t), "
        f"(a, x) -> named_struct('e', a.e + coalesce(x.w * (x.t - a.t), 0.0D) / {HOUR}, 't', x.t), a -> a.e)")
    return pieces.select(
        series, F.window_time("w").alias("until"), "n", F.expr("s[0].t").alias("first_t"), F.expr("s[0].w").alias("first_w"),
        F.expr("element_at(s, -1).t").alias("last_t"), "cpu", "n_cpu", "ram", "watts", "n_watts", inner.alias("wh"))


class _Runs(StatefulProcessor):
    """The open run of a series; ``gap`` and ``piece`` are in microseconds."""

    def __init__(self, series: str, gap: int, piece: int):
        self.series, self.gap, self.piece = series, gap, piece

    def init(self, handle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, closed = self.run.get() if self.run.exists() else None, []
        pieces = pd.concat(list(rows), ignore_index=True).sort_values("first_t", kind="stable")
        for p in pieces.itertuples(index=False):
            cpu, watts, w = (0.0 if pd.isna(x) else float(x) for x in (p.cpu, p.watts, p.first_w))
            if run is not None and p.first_t - run[1] >= self.gap:
                closed.append(run)
                run = None
            if run is None:
                run = (int(p.first_t), int(p.last_t), int(p.n), cpu, int(p.n_cpu), None if pd.isna(p.ram) else float(p.ram),
                       watts, int(p.n_watts), float(p.wh))
                continue
            ram = [x for x in (run[5], p.ram) if not pd.isna(x)]
            run = (run[0], max(run[1], int(p.last_t)), run[2] + int(p.n), run[3] + cpu, run[4] + int(p.n_cpu),
                   float(max(ram)) if ram else None, run[6] + watts, run[7] + int(p.n_watts),
                   run[8] + float(p.wh) + w * (int(p.first_t) - run[1]) / HOUR)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.run.update(run)
        # A sample before the end of the pause lies in a piece that has been handed on by then.
        self.handle.registerTimer((run[1] + self.gap + self.piece) // 1000 + 1)
        yield self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = self.run.get()
        self.run.clear()
        yield self._rows(key, [run])

    def _rows(self, key, runs) -> pd.DataFrame:
        out = pd.DataFrame(runs, columns=["run_start", "last_t", "n_samples", "cpu", "n_cpu", "ram", "watts", "n_watts", "wh"])
        return pd.DataFrame({
            self.series: pd.Series([key[0]] * len(out), dtype=object), "run_start": out["run_start"].astype("int64"),
            "n_samples": out["n_samples"].astype("int64"),
            "runtime_seconds": (out["last_t"].astype("int64") - out["run_start"].astype("int64")) / 1e6,
            "average_cpu_percent": [c / n if n else None for c, n in zip(out["cpu"], out["n_cpu"])],
            "peak_ram_mb": out["ram"].astype("float64"),
            "average_watts": [c / n if n else None for c, n in zip(out["watts"], out["n_watts"])],
            "energy_wh": out["wh"].astype("float64")})

    def close(self) -> None:
        pass


def stream_runs(stream: DataFrame, series: str, ts: str, tie: str, gap: int, lateness: str, piece: int = 600_000_000) -> DataFrame:
    """A row per run of a series, emitted when the run has ended: span, count, means, peak and energy.

    A run goes on while its samples are less than ``gap`` microseconds apart; ``gap`` is at least one ``piece``.
    Needs the RocksDB state store (``run_closed`` sets it).
    """
    if gap < piece:
        raise ValueError("gap must be at least as long as a piece")
    kind = stream.schema[series].dataType.simpleString()
    pieces = run_pieces(stream, series, ts, tie, f"{piece} microseconds", lateness)
    return pieces.groupBy(series).transformWithStateInPandas(
        _Runs(series, gap, piece), f"{series} {kind}, run_start long, n_samples long, runtime_seconds double, "
        "average_cpu_percent double, peak_ram_mb double, average_watts double, energy_wh double", "Append", "EventTime")
