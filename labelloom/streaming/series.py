"""Structured Streaming forms of the series operators.

Late rows: the watermark drops rows older than ``lateness``; the number dropped is in the progress of the query
(``dropped_rows``). Files read in one trigger may be in any order; over several triggers they must come in the order of
their events, up to ``lateness``.

``run_closed`` ends a stream: a marker row far behind all events moves the watermark on, so that the stream itself closes and
emits what it still holds open, and no batch pass is needed for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelloom.session import is_folder, scratch_path

END = "9999-01-01"  # time of the marker that closes a stream; events lie before it
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema, name: str = "*.parquet", max_files: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; the file count bounds a micro-batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name) \
        .option("maxFilesPerTrigger", max_files).parquet(path)


def table_stream(spark: SparkSession, folder: str, name: str, schema, max_files: int = 1000) -> DataFrame:
    """A table as a stream, whether it is one file ``folder/name`` or a folder of part files of that name."""
    path = f"{folder}/{name}"
    return read_stream(spark, path, schema, max_files=max_files) if is_folder(spark, path) \
        else read_stream(spark, folder, schema, name, max_files)


def watermarked(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """The stream with its watermark, without the marker that ``run_closed`` adds.

    The condition is on the event time, so it stays above the watermark and the marker counts for it.
    """
    return stream.withWatermark(ts, lateness).where(F.col(ts) < F.lit(END).cast("timestamp"))


def run_available(stream: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Process everything that is there into a parquet table, exactly once, then stop."""
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "stream-checkpoint")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return query


def run_open(stream: DataFrame, make, ts: str, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there of ``make(stream)`` and keep the stream open for more and for ``close_stream``."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{checkpoint}-end")
    marks = read_stream(spark, f"{checkpoint}-end", stream.schema)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # timers and state variables need it
    try:
        return run_available(make(stream.unionByName(marks)), path, checkpoint)
    finally:
        spark.conf.set(PROVIDER, before)


def close_stream(stream: DataFrame, make, ts: str, path: str, checkpoint: str) -> StreamingQuery:
    """Add the marker and let the stream emit all that is open; later events would be late."""
    spark = stream.sparkSession
    marker = [(F.lit(END) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    spark.range(1).select(*marker).write.mode("append").parquet(f"{checkpoint}-end")
    return run_open(stream, make, ts, path, checkpoint)


def run_closed(stream: DataFrame, make, ts: str, path: str, checkpoint: str | None = None) -> tuple[DataFrame, int]:
    """All rows of ``make(stream)`` from the first event to the last, and the number of rows dropped as late.

    ``make`` sets the watermark by ``watermarked``.
    """
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "stream-checkpoint")
    queries = [run(stream, make, ts, path, checkpoint) for run in (run_open, close_stream)]
    rows = stream.sparkSession.read.schema(make(stream).schema).parquet(path)
    return rows, sum(dropped_rows(q) for q in queries)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped over the recorded progress; before a window, those of one task and window count once."""
    return sum(
        op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators
    )


def stream_windows(stream: DataFrame, series: str, ts: str, value: str, step: str, lateness: str) -> DataFrame:
    """Mean, maximum and count per series and window, emitted when the window closes."""
    return (
        watermarked(stream, ts, lateness)
        .groupBy(series, F.window(ts, step).alias("w"))
        .agg(F.avg(value).alias("mean_value"), F.max(value).alias("max_value"), F.count("*").alias("n_samples"))
        .select(series, F.col("w.start").alias("window_start"), "mean_value", "max_value", "n_samples")
    )


def stream_sessions(stream: DataFrame, series: str, ts: str, gap: str, lateness: str) -> DataFrame:
    """Runs of a series without a pause longer than ``gap``: span, count, mean CPU, peak RAM."""
    return (
        watermarked(stream, ts, lateness)
        .groupBy(series, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("n_samples"), F.avg("cpu_percent").alias("average_cpu_percent"),
             F.max("ram_mb").alias("peak_ram_mb"), F.max(ts).alias("last_ts"))
        .select(series, F.col("w.start").alias("run_start"), "last_ts", "n_samples", "average_cpu_percent", "peak_ram_mb")
    )
