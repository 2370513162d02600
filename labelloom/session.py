"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str = "labelloom", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Encoder, scorer and kNN functions are pickled by module name, and workers do
    not share the driver's import path.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        home = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="labelloom-")) / home.name
        spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", home.parent, home.name))
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    A machine-local folder is used only where the setting is missing and the
    master is local, as in tests.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="labelloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path below one folder per application, which may be removed after the run."""
    return f"{shared_dir(spark)}/labelloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of any path that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def has_parts(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a written part file. A table of one file is there as a whole or not at all."""
    fs, at = file_system(spark, path)
    return fs.exists(at) and any(e.getPath().getName().startswith("part-") for e in fs.listStatus(at))


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's scratch folder; frames read from it are gone afterwards."""
    fs, at = file_system(spark, f"{shared_dir(spark)}/labelloom/{spark.sparkContext.applicationId}")
    fs.delete(at, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Used where one expensive frame feeds several branches: the written table
    survives lost executors and is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the folder that ``materialize`` wrote ``df`` to; nothing may read it any more."""
    spark = df.sparkSession
    scratch = f"/labelloom/{spark.sparkContext.applicationId}/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if scratch in folder:
            fs, at = file_system(spark, folder)
            fs.delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that are gone; it does so only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy work one partition per core when the input has fewer.

    Large inputs already come in more splits than cores and pass unchanged. For
    scans only: counting the partitions of a shuffled frame would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _row_bytes(df: DataFrame):
    """Expression for about the bytes of a row: fixed columns count 8, others by their length."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(column)
        elif isinstance(kind, T.ArrayType):
            size = F.size(column) * 8
        elif isinstance(kind, VectorUDT):
            size = F.size(vector_to_array(column)) * 8
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(0))
    return total


def table_size(df: DataFrame) -> tuple[int, int]:
    """Rows and about the bytes of a table, payloads and keys included."""
    row = df.agg(F.count("*").alias("n"), F.sum(_row_bytes(df)).alias("b")).first()
    return row["n"], row["b"] or 0


def checked_broadcast(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast ``df`` only after counting that it is within ``max_rows`` and about ``max_bytes``.

    Beyond a bound the frame is returned unhinted, so the join is a shuffle
    join that AQE can split on skew. The count computes the frame: pass written
    or aggregated ones.
    """
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(_row_bytes(df)).alias("b")).first()
    return F.broadcast(df) if seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes else df


def bounded_values(df: DataFrame, column: str, max_values: int = 10_000) -> list:
    """Sorted distinct non-null values of a closed domain (labels, categories).

    Raises when the domain is larger than ``max_values``: it is then not a
    closed list and must stay a DataFrame.
    """
    rows = (
        df.select(column).where(F.col(column).isNotNull()).distinct()
        .limit(max_values + 1).collect()
    )
    if len(rows) > max_values:
        raise ValueError(f"{column} has more than {max_values} distinct values")
    return sorted(r[0] for r in rows)
