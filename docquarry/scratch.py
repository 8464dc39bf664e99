"""Intermediate tables in the folder that the cluster shares.

An operator that reads a result twice, or that iterates, writes it here and
reads it back: the lineage is cut, and a lost executor costs a re-read only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def folder(spark: SparkSession) -> str:
    """Where this application keeps its tables."""
    return f"{root(spark)}/docquarry-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str, *, compression: str = "snappy", partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and return it read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._docquarry_path = path
    return back


def drop(df: DataFrame | str | None, spark: SparkSession | None = None) -> None:
    """Delete a table that keep() made, or a path; other frames are left alone."""
    path = df if isinstance(df, str) else getattr(df, "_docquarry_path", None)
    if path is None:
        return
    _delete(spark or df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete all tables of this application, once no frame over them is needed."""
    _delete(spark, folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
