"""Intermediate tables in the shared folder of the cluster.

A stage that several later jobs read is written once as Parquet and read back.  The
written table cuts the lineage, survives the loss of executors and keeps column pruning,
which a row-format checkpoint would not.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_once: dict[tuple[str, str], tuple[str, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else a test folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            configured = tempfile.mkdtemp(prefix="ebbtide-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core for iterative fits; a large table is left alone.

    For frames that are a scan and projections: their partition count is known for free.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of jobs that nothing refers to any more deleted, which waits for a collection of the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_once(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Like ``stage``, but written once per application and label."""
    key = (spark.sparkContext.applicationId, label)
    if key in _once:
        path, schema = _once[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            del _once[key]  # the folder was cleaned: build again
    df = build()
    path = new_path(spark, label.replace("/", "_"))
    df.write.parquet(path)
    _once[key] = (path, df.schema)
    return spark.read.schema(df.schema).parquet(path)
