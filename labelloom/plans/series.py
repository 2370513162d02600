"""Registered queries: resource time series in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import timeseries as ts
from labelloom.plans import views as v
from labelloom.plans.neighbours import rounded
from labelloom.plans.registry import query

STEP = 6 * 3600 * ts.SECOND
S = v.SAMPLES
ORDER = "PARTITION BY series_id ORDER BY t, event_id"


@query("tick_rollup", f"""WITH {S} SELECT series_id, t // 86400000000 AS tick, cast(sum(cpu_percent) AS BIGINT) AS cpu_percent_raw, round(sum(cpu_percent) / {v.CORES}, 6) AS cpu_percent_normalized,
  cast(sum(ram_mb) AS BIGINT) AS ram_mb, count(*) AS n_processes FROM samples GROUP BY ALL""")
def tick_rollup(spark, d):
    """Daily ticks; every event of a tick stands for a process."""
    rows = v.samples(spark, d).withColumn("tick", F.floor(F.col("t") / 86_400_000_000))
    return rounded(ts.tick_rollup(rows, "series_id", "tick", v.CORES))


@query("power_estimate", f"""WITH {S} SELECT event_id, round({v.BASE_WATTS}::DOUBLE + least(1, cpu_percent / 100) * {v.TDP - v.BASE_WATTS}::DOUBLE, 6) AS cpu_watts,
  round({v.BASE_WATTS}::DOUBLE + least(1, cpu_percent / 100) * {v.TDP - v.BASE_WATTS}::DOUBLE + watts, 6) AS total_watts FROM samples""")
def power_estimate(spark, d):
    rows = v.samples(spark, d)
    return rounded(rows.select(
        "event_id", ts.power(F.col("cpu_percent"), v.TDP, v.BASE_WATTS).alias("cpu_watts"),
        ts.power(F.col("cpu_percent"), v.TDP, v.BASE_WATTS, F.col("watts")).alias("total_watts")))


LAGGED = f"lagged AS (SELECT *, coalesce((t - lag(t) OVER ({ORDER})) / 1000000 / 3600, 0) AS dh FROM samples)"


@query("energy_integral", f"WITH {S}, {LAGGED} SELECT series_id, round(sum(watts * dh), 6) AS energy_wh, count(*) AS n_samples FROM lagged GROUP BY series_id")
def energy_integral(spark, d):
    return rounded(ts.energy(v.samples(spark, d), "series_id", "t", "event_id"))


@query("run_summary", f"""WITH {S}, {LAGGED} SELECT series_id, round((max(t) - min(t)) / 1000000, 2) AS total_runtime_seconds, count(*) AS n_samples,
  round(avg(cpu_percent), 2) AS average_cpu_percent, max(ram_mb) AS peak_ram_mb, round(avg(watts), 2) AS average_watts,
  round(sum(watts * dh), 6) AS estimated_total_energy_wh FROM lagged GROUP BY series_id""")
def run_summary(spark, d):
    return ts.run_summary(v.samples(spark, d), "series_id", "t", "event_id")


CELLS = f"""span AS (SELECT series_id, min(t) AS t0, max(t) AS t1 FROM samples GROUP BY series_id),
  cells AS (SELECT s.*, t0, t1, (t - t0) // {STEP} AS cell FROM samples s JOIN span USING (series_id)),
  means AS (SELECT series_id, cell, t AS t, watts::DOUBLE AS watts, cpu_percent::DOUBLE AS cpu_percent, 1::BIGINT AS n_samples FROM cells WHERE t1 - t0 < {STEP}
    UNION ALL SELECT series_id, cell, min(t0) + cell * {STEP}, avg(watts), avg(cpu_percent), count(*) FROM cells WHERE t1 - t0 >= {STEP} GROUP BY series_id, cell)"""


@query("resample_mean", f"WITH {S}, {CELLS} SELECT series_id, cell, t, round(watts, 6) AS watts, round(cpu_percent, 6) AS cpu_percent, n_samples FROM means")
def resample_mean(spark, d):
    return rounded(ts.resample(v.samples(spark, d), "series_id", "t", "event_id", ["watts", "cpu_percent"], STEP, fill=False))


@query("gap_interpolate", f"""WITH {S}, {CELLS}, grid AS (SELECT series_id, t0, unnest(range(cast(ceil((t1 - t0) / {STEP}) AS BIGINT) + 1)) AS cell FROM span WHERE t1 - t0 >= {STEP}),
  empty AS (SELECT g.series_id, g.cell, g.t0 + g.cell * {STEP} AS t FROM grid g ANTI JOIN cells c ON c.series_id = g.series_id AND c.cell = g.cell),
  prev AS (SELECT e.*, max((s.t, s.event_id)) AS k FROM empty e JOIN samples s ON s.series_id = e.series_id AND s.t <= e.t GROUP BY ALL),
  nxt AS (SELECT e.series_id, e.cell, min((s.t, s.event_id)) AS k FROM empty e JOIN samples s ON s.series_id = e.series_id AND s.t > e.t GROUP BY ALL),
  lines AS (SELECT p.series_id, p.cell, p.t, a.t AS ta, a.watts AS wa, a.cpu_percent AS ca, b.t AS tb, b.watts AS wb, b.cpu_percent AS cb
    FROM prev p JOIN samples a ON (a.t, a.event_id) = p.k AND a.series_id = p.series_id LEFT JOIN nxt n ON n.series_id = p.series_id AND n.cell = p.cell
    LEFT JOIN samples b ON (b.t, b.event_id) = n.k AND b.series_id = p.series_id)
  SELECT series_id, cell, t, round(watts, 6) AS watts, round(cpu_percent, 6) AS cpu_percent, n_samples FROM means
  UNION ALL SELECT series_id, cell, t, round(CASE WHEN tb IS NULL THEN wa ELSE wa + (wb - wa) * ((t - ta) / (tb - ta)) END, 6),
  round(CASE WHEN tb IS NULL THEN ca ELSE ca + (cb - ca) * ((t - ta) / (tb - ta)) END, 6), 0 FROM lines""")
def gap_interpolate(spark, d):
    return rounded(ts.resample(v.samples(spark, d), "series_id", "t", "event_id", ["watts", "cpu_percent"], STEP))


def smooth_sql(window: int) -> str:
    h = window // 2
    frame = f"OVER ({ORDER} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    return f"""WITH {S}, r AS (SELECT *, row_number() OVER ({ORDER}) AS pos, count(*) OVER (PARTITION BY series_id) AS n,
  first_value(watts) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a,
  last_value(watts) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z, sum(watts) {frame} AS s FROM samples)
  SELECT series_id, pos, t, round(CASE WHEN n < {window} THEN watts ELSE (s + a * greatest(0, {h} - pos + 1) + z * greatest(0, pos + {h} - n)) / {window} END, 6) AS smoothed FROM r"""


@query("centered_smooth", smooth_sql(3))
def centered_smooth(spark, d):
    return rounded(ts.smooth(v.samples(spark, d), "series_id", "t", "event_id", "watts", 3))


@query("centered_smooth_wide", smooth_sql(7))
def centered_smooth_wide(spark, d):
    return rounded(ts.smooth(v.samples(spark, d), "series_id", "t", "event_id", "watts", 7))


@query("peak_annotate", f"WITH {S} SELECT series_id, max(watts) AS peak, arg_max(t, (watts, -t)) AS peak_t, round(avg(watts), 6) AS mean FROM samples GROUP BY series_id")
def peak_annotate(spark, d):
    return rounded(ts.peaks(v.samples(spark, d), "series_id", "t", "watts"))
