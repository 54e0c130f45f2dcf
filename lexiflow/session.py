"""Session helpers: a local session for tests and benches, and scan spreading.

On a cluster the caller owns the session; nothing here overrides settings that
are already present, except for the local builder used by tests and bench.
"""
from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "lexiflow") -> SparkSession:
    """Local session with the settings tests and bench use (UI off, AQE on)."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cores
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(SCAN_PARTITIONS, str(cores))
    return spark


def storage_folder(spark: SparkSession) -> str:
    """The folder for stored intermediate tables: ``spark.checkpoint.dir``, which
    a cluster names and all executors share; where it is unset, a folder in
    the session's warehouse, which executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored"


#: Session setting: number of partitions to spread a corpus scan over.
SCAN_PARTITIONS = "lexiflow.scan.partitions"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread rows over ``partitions`` (or the session's ``SCAN_PARTITIONS``) for
    inputs that a scan cannot split, such as one file of one row group. Off
    unless asked for: inputs of many splits need no shuffle."""
    partitions = partitions or int(df.sparkSession.conf.get(SCAN_PARTITIONS, None) or 0)
    return df.repartition(partitions) if partitions else df


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Compute ``df`` once: write it as Parquet to ``folder`` (default: the
    session's storage folder) and read it back. The lineage ends there, so a
    lost executor costs a read."""
    path = f"{folder or storage_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` stored and nothing reads any more, and lets
    Spark delete the shuffle files of plans that nobody holds: it does so when they are collected as
    garbage, which in a driver with much memory may not happen for an hour."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()
