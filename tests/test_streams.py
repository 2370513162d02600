"""Streams that end, run summaries from keyed state, and tables of one file or of part files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from labelloom.plans import streams
from labelloom.streaming import series as sr
from labelloom.streaming.runs import stream_runs

SCHEMA = "series string, id long, ts timestamp, watts double, cpu_percent long, ram_mb long"
MINUTE = 60_000_000


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def sample(i, seconds, series="s", watts=None):
    return series, i, at(seconds), float(i % 7) if watts is None else watts, i % 50, i % 900


def by_hand(rows, gap):
    """Runs of sorted samples: start, count, span, means, peak, watt-hours."""
    out, run = [], []
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if run and (r[2] - run[-1][2]).total_seconds() >= gap:
            out.append(run)
            run = []
        run.append(r)
    out += [run] if run else []
    return sorted((len(r), (r[-1][2] - r[0][2]).total_seconds(), round(sum(x[4] for x in r) / len(r), 6), max(x[5] for x in r),
                   round(sum(b[3] * (b[2] - a[2]).total_seconds() / 3600 for a, b in zip(r, r[1:])), 6)) for r in out)


def shown(df):
    return sorted((r.n_samples, r.runtime_seconds, round(r.average_cpu_percent, 6), r.peak_ram_mb, round(r.energy_wh, 6)) for r in df.collect())


def make(gap=30 * MINUTE):
    return lambda s: stream_runs(s, "series", "ts", "id", gap, "20 minutes", piece=5 * MINUTE)


def read(spark, src):
    return sr.read_stream(spark, src, SCHEMA, max_files=1)


def test_runs_over_many_batches_with_rows_out_of_order(spark, tmp_path):
    rng, seconds, rows = random.Random(1), 0, []
    for i in range(400):
        seconds += rng.choice([1, 5, 60, 200, 290, 310, 1799, 1800, 1801]) if i % 9 else 7200
        rows.append(sample(i, seconds))
    rows += [sample(1000 + i, seconds + i // 2) for i in range(3)]  # ties
    src = str(tmp_path / "in")
    for i in range(0, len(rows), 101):
        some = rows[i:i + 101]
        rng.shuffle(some)
        write(spark, src, some)
    got, late = sr.run_closed(read(spark, src), make(), "ts", str(tmp_path / "out"))
    assert late == 0 and shown(got) == by_hand(rows, 1800)


def test_null_readings_and_null_series(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [("s", 1, at(0), None, None, None), ("s", 2, at(3600), 2.0, 10, None), (None, 3, at(5), 1.0, 1, 1), ("t", 4, at(9), None, None, None)])
    rows, _ = sr.run_closed(read(spark, src), make(7200 * 1_000_000), "ts", str(tmp_path / "out"))
    got = {r.series: r for r in rows.collect()}
    assert (got["s"].n_samples, got["s"].average_cpu_percent, got["s"].peak_ram_mb, got["s"].average_watts, got["s"].energy_wh) == (2, 10.0, None, 2.0, 2.0)
    assert got[None].n_samples == 1 and got["t"].average_watts is None and got["t"].energy_wh == 0


def test_runs_come_from_the_stream_before_its_end_and_after_a_restart(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    first, second = [sample(i, i * 60) for i in range(20)], [sample(20 + i, 100_000 + i * 60) for i in range(20)]
    write(spark, src, first)
    sr.run_open(read(spark, src), make(), "ts", out, check)
    assert spark.read.parquet(out).count() == 0  # the run may go on
    write(spark, src, second)
    sr.run_open(read(spark, src), make(), "ts", out, check)
    # The restarted stream knows the first run from its state and closes it by its timer.
    assert shown(spark.read.parquet(out)) == by_hand(first, 1800)
    sr.close_stream(read(spark, src), make(), "ts", out, check)
    sr.close_stream(read(spark, src), make(), "ts", out, check)
    assert shown(spark.read.parquet(out)) == by_hand(first + second, 1800)


def test_late_rows_are_counted(spark, tmp_path):
    src = str(tmp_path / "in")
    for rows in ([sample(1, 50_000)], [sample(2, 60_000)], [sample(3, 5), sample(4, 400)]):
        write(spark, src, rows)
    rows, late = sr.run_closed(read(spark, src), make(), "ts", str(tmp_path / "out"))
    assert late == 2 and rows.agg(F.sum("n_samples")).first()[0] == 2


def test_a_stream_without_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(src)
    rows, late = sr.run_closed(read(spark, src), make(), "ts", str(tmp_path / "out"))
    assert (rows.count(), late) == (0, 0)


def test_gap_shorter_than_a_piece_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        stream_runs(spark.createDataFrame([], SCHEMA), "series", "ts", "id", MINUTE, "1 minute")


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    """The tables the streams read, as folders of part files."""
    path = str(tmp_path_factory.mktemp("folders"))
    for name in ("events", "documents", "labels", "embeddings"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(5).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", ["stream_resample", "stream_run_summary", "stream_sessions", "stream_score",
                                  "stream_cache_dedup", "stream_metrics", "stream_merge_results"])
def test_files_and_folders_give_the_same_rows(spark, sf, folders, name, monkeypatch):
    read = []
    table_stream = sr.table_stream
    monkeypatch.setattr(sr, "table_stream", lambda spark, d, table, *a: read.append((d, table)) or table_stream(spark, d, table, *a))
    run = getattr(streams, name)
    a, b = (sorted(map(str, run(spark, d).collect())) for d in (sf, folders))
    assert a and a == b and {d for d, _ in read} == {sf, folders}
    # The stream itself has read every row of its table.
    table = read[0][1]
    path = sr.scratch_path(spark, "seen")
    sr.run_available(table_stream(spark, folders, table, spark.read.parquet(f"{folders}/{table}").schema), path)
    assert spark.read.parquet(path).count() == spark.read.parquet(f"{sf}/{table}").count()
