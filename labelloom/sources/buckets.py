"""A versioned table in key buckets: an upsert rewrites only the buckets its keys fall into.

Layout below ``path``: ``data/version=V/bucket=B`` holds the rows of a bucket as version V left them, ``manifest/version=V``
one row per non-empty bucket with the version that wrote it, in one file. A version exists once that file is there, so a
writer that dies leaves nothing that readers see, and doing a version again that is there changes nothing. Readers take
the newest manifest and read just the folders it names; a reader of an older version is not disturbed until
``vacuum``. One writer at a time.

Defined results: rows with the same keys replace each other, null keys are equal to each other; of several updates with
the same keys the one with the largest ``order`` stays (all columns break ties); an empty update makes a version equal
to the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelloom.session import file_system, has_parts, materialize

BUCKET = "__bucket"


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        fs, at = file_system(self.spark, f"{self.path}/manifest")
        if not fs.exists(at):
            return []
        names = [entry.getPath().getName() for entry in fs.listStatus(at)]
        found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=") and has_parts(self.spark, f"{self.path}/manifest/{n}")]
        return sorted(found)

    def homes(self, version: int | None) -> dict[int, int]:
        """Bucket -> version that wrote it; at most one entry per bucket."""
        if version is None:
            return {}
        rows = self.spark.read.schema("bucket int, home long").parquet(f"{self.path}/manifest/version={version}").collect()
        return {r["bucket"]: r["home"] for r in rows}

    def _folder(self, bucket: int, home: int) -> str:
        return f"{self.path}/data/version={home}/bucket={bucket}"

    def _read(self, homes: dict[int, int]) -> DataFrame:
        paths = [self._folder(b, h) for b, h in sorted(homes.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, the newest one by default; none when nothing has been stored."""
        if version is None:
            version = max(self.versions(), default=None)
        return self._read(self.homes(version))

    def upsert(self, updates: DataFrame, version: int | None = None, order: str | None = None) -> int:
        """Insert or replace by key as ``version`` (the next one by default), on top of the version before it."""
        every = self.versions()
        version = max(every, default=-1) + 1 if version is None else version
        if version in every:
            return version
        before = self.homes(max((v for v in every if v < version), default=None))
        rows = updates.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        row = F.struct(*([F.col(order).alias("__order")] if order else []), *self.schema.names)
        picked = rows.groupBy(*self.keys).agg(F.max(row).alias("__row"))
        # Written once: the batch may not be the same when it is computed again.
        picked = materialize(picked.select(*[F.col(f"__row.{c}").alias(c) for c in self.schema.names]).withColumn(BUCKET, bucket), "upsert")
        touched = {r[0] for r in picked.select(BUCKET).distinct().collect()}  # at most one value per bucket
        old = self._read({b: h for b, h in before.items() if b in touched}).withColumn(BUCKET, bucket)
        same = [old[k].eqNullSafe(picked[k]) for k in self.keys]
        kept = old.join(picked, [old[BUCKET] == picked[BUCKET], *same], "left_anti")
        merged = kept.unionByName(picked)
        if touched:
            merged.repartition(BUCKET).withColumnRenamed(BUCKET, "bucket") \
                .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        homes = sorted((before | dict.fromkeys(touched, version)).items())
        self.spark.createDataFrame(homes, "bucket int, home long").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return version

    def vacuum(self, keep: int = 1) -> int:
        """Delete what the newest ``keep`` versions do not name; returns the number of bucket folders deleted."""
        every = self.versions()
        named = {(b, h) for v in every[-keep:] for b, h in self.homes(v).items()}
        for v in every[:-keep]:
            fs, at = file_system(self.spark, f"{self.path}/manifest/version={v}")
            fs.delete(at, True)
        gone = 0
        fs, at = file_system(self.spark, f"{self.path}/data")
        for folder in fs.listStatus(at) if fs.exists(at) else []:
            home = int(folder.getPath().getName().removeprefix("version="))
            for entry in fs.listStatus(folder.getPath()):
                name = entry.getPath().getName()
                if name.startswith("bucket=") and (int(name.removeprefix("bucket=")), home) not in named:
                    fs.delete(entry.getPath(), True)
                    gone += 1
        return gone
