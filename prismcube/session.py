"""Session helpers: table loading, size checks and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a test-data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is used, but only for a
    ``local[...]`` master; elsewhere its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = getattr(sc, "_prismcube_shared", None)
    if base is None:
        base = sc._prismcube_shared = "file://" + tempfile.mkdtemp(prefix="prismcube-")
    sc.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it does not exist."""
    at, fs = _folder(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder with all that is in it."""
    at, fs = _folder(spark, path)
    fs.delete(at, True)


def materialise(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
