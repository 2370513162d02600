"""Streaming scoring, duplicate suppression, running metrics and result merging."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from labelloom.sources.buckets import BucketTable


def stream_dedup(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Pass a key once; its state is kept for ``delay`` of event time."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def newest(spark, path: str, schema) -> DataFrame:
    """Rows of the newest version stored below ``path``; none when nothing has been stored."""
    try:
        every = spark.read.schema(StructType([*schema.fields, StructField("version", LongType())])).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    last = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == F.lit(last)).drop("version")


def stream_confusion(stream: DataFrame, path: str, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Running (true, pred) counts; every micro-batch stores the small result table as a version of its own.

    The checkpoint beside ``path`` and the stored versions are all the state there is, so a restart goes on.
    """
    counts = stream.groupBy(true, pred).agg(F.count("*").alias("n"))

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    query = (
        counts.writeStream.outputMode("complete").foreachBatch(publish)
        .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return newest(stream.sparkSession, path, counts.schema)


def foreach_merge(stream: DataFrame, start: DataFrame, keys: list[str], path: str, buckets: int = 64, order: str | None = None) -> DataFrame:
    """Merge each micro-batch of result rows into a bucketed table; what a batch writes follows the batch.

    The start table is version 0 and batch n is version n + 1, so a repeated batch changes nothing and a restart goes on.
    """
    table = BucketTable(stream.sparkSession, path, start.schema, keys, buckets)
    table.upsert(start, 0)
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: table.upsert(batch, batch_id + 1, order))
        .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return table.read()
