"""Spark helpers of the training-data operators."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster
    without the setting is an error, since executors would write to disks
    that others cannot see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexiflow-shared-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage
    ends there, and a lost executor costs a read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lexiflow-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as empty text)."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 64-bit name of a row's id and text, for joins where ids may be missing
    or repeated."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
