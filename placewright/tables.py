"""Intermediate tables in the shared folder: they end a plan's lineage, are computed once, and cost only a reread when an executor is lost."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder(app: str) -> str:
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: one of our own on a local master, which goes when the process ends; an error on a
    cluster, whose executors don't see each other's folders."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back. The folder's own clean-up removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into as many partitions as the session has for shuffles. For joins that make many rows of few: adaptive execution would put their small
    inputs into one task, as it looks at the bytes that go in."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
