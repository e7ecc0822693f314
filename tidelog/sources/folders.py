"""Folders that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the application ends.

    Where that is unset a local session makes one; on a cluster it is an error,
    as executors would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tidelog-{uuid.uuid4().hex}"
    files, target = _at(spark, path)
    files.deleteOnExit(target)
    return path


def written(df: DataFrame) -> DataFrame:
    """Write a DataFrame to a shared folder and read it back: lineage ends here."""
    path, schema = shared(df.sparkSession), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system it is."""
    files, target = _at(spark, path)
    files.delete(target, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    files, target = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []


def claim(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it is there already."""
    files, target = _at(spark, path)
    try:
        files.create(target, False).close()
    except Exception as taken:  # the file system says so in its own words
        if files.exists(target):
            return False
        raise taken
    return True
