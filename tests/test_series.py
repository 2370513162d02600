"""Series operators on short hand-made series and in streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from labelloom.operators import timeseries as ts
from labelloom.streaming import scoring as ss
from labelloom.streaming import series as sr

S = 1_000_000


def series(spark, points, name="s"):
    rows = [(name, int(t * S), i, float(w)) for i, (t, w) in enumerate(points)]
    return spark.createDataFrame(rows, "series string, t long, id long, watts double")


def test_energy_right_hand_rule(spark):
    row = ts.energy(series(spark, [(0, 9), (3600, 10), (5400, 20)]), "series", "t", "id").first()
    assert row.energy_wh == pytest.approx(10 + 10)


def test_one_sample(spark):
    df = series(spark, [(5, 7)])
    assert ts.energy(df, "series", "t", "id").first().energy_wh == 0
    out = ts.resample(df, "series", "t", "id", ["watts"], S).collect()
    assert [(r.t, r.watts) for r in out] == [(5 * S, 7.0)]


def test_short_series_is_returned_untouched(spark):
    df = series(spark, [(0, 1), (0.2, 5), (0.2, 6)])
    out = ts.resample(df, "series", "t", "id", ["watts"], S).collect()
    assert sorted(r.watts for r in out) == [1, 5, 6]


def test_wide_gap_is_interpolated(spark):
    out = ts.resample(series(spark, [(0, 0), (10, 20)]), "series", "t", "id", ["watts"], S).orderBy("cell").collect()
    assert [r.cell for r in out] == list(range(11))
    assert [r.watts for r in out] == pytest.approx([2.0 * i for i in range(11)])
    assert sum(r.n_samples == 0 for r in out) == 9


def test_grid_ends_after_last_sample_and_clamps(spark):
    out = ts.resample(series(spark, [(0, 1), (0.5, 3), (2.5, 8)]), "series", "t", "id", ["watts"], S).orderBy("cell").collect()
    # Cell 1 is empty: the line from 0.5 s to 2.5 s at 1 s; the point at 3 s takes the last value.
    assert [(r.cell, round(r.watts, 6)) for r in out] == [(0, 2.0), (1, 4.25), (2, 8.0), (3, 8.0)]


def test_smooth(spark):
    got = ts.smooth(series(spark, [(0, 1), (1, 2), (2, 6)]), "series", "t", "id", "watts", 3).orderBy("pos").collect()
    assert [r.smoothed for r in got] == pytest.approx([4 / 3, 3, 14 / 3])
    assert [r.t for r in got] == [0, S, 2 * S]
    same = ts.smooth(series(spark, [(0, 1), (1, 2)]), "series", "t", "id", "watts", 3).orderBy("pos").collect()
    assert [r.smoothed for r in same] == [1, 2]


def test_smooth_hot_series_equals_numpy(spark):
    import numpy as np

    values = [float((i * 37) % 101) for i in range(500)]
    got = ts.smooth(series(spark, list(enumerate(values))), "series", "t", "id", "watts", 9).orderBy("pos").collect()
    padded = np.pad(values, 4, mode="edge")
    assert [r.smoothed for r in got] == pytest.approx(np.convolve(padded, np.ones(9) / 9, "valid").tolist())


def test_peak_is_the_first_of_equal(spark):
    row = ts.peaks(series(spark, [(0, 1), (1, 9), (2, 9)]), "series", "t", "watts").first()
    assert (row.peak, row.peak_t) == (9.0, S)


def test_power_is_capped(spark):
    row = spark.createDataFrame([(50.0,), (250.0,)], "c double").select(ts.power(F.col("c"), 65.0, 10.0).alias("w")).collect()
    assert [r.w for r in row] == [37.5, 65.0]


def write_events(spark, path, rows):
    spark.createDataFrame(rows, "series string, ts timestamp, watts double").coalesce(1).write.mode("append").parquet(path)


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_restart_resumes_without_repeats(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    write_events(spark, src, [("s", at(0), 1.0)])
    read = lambda: sr.read_stream(spark, src, "series string, ts timestamp, watts double")
    sr.run_available(read(), out, check)
    write_events(spark, src, [("s", at(1), 2.0)])
    sr.run_available(read(), out, check)
    assert spark.read.parquet(out).count() == 2


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    src = str(tmp_path / "in")
    write_events(spark, src, [("s", at(7200), 1.0)])
    write_events(spark, src, [("s", at(10_800), 1.0)])
    write_events(spark, src, [("s", at(5), 1.0)])
    stream = sr.read_stream(spark, src, "series string, ts timestamp, watts double", max_files=1)
    query = sr.run_available(sr.stream_windows(stream, "series", "ts", "watts", "1 minute", "10 seconds"), str(tmp_path / "out"))
    assert sr.dropped_rows(query) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_stream_dedup_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for s in (0, 10, 20):
        write_events(spark, src, [("k", at(s), 1.0), ("k", at(s + 1), 1.0)])
    stream = sr.read_stream(spark, src, "series string, ts timestamp, watts double", max_files=1)
    sr.run_available(ss.stream_dedup(stream, "series", "ts", "1 hour"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
