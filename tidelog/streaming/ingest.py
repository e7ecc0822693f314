"""Streams of operations.

Newest-wins is idempotent, so a sink that appends each batch's newest versions
needs no state and no exactly-once sink: a repeated batch adds rows that lose or
tie with themselves.  Late operations lose by their sequence number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import LOG
from tidelog.operators.reads import latest


def source(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def newest(stream: DataFrame) -> DataFrame:
    """Keyed state: the newest version of each key, to be written in update mode."""
    best = F.max_by(F.struct("value", "op", "seq"), "seq").alias("v")
    return stream.groupBy("key").agg(best).select("key", "v.value", "v.op", "v.seq")


def append_newest(stream: DataFrame, folder: str, checkpoint: str):
    """Run over what is there: append the newest versions of each batch to ``folder``."""
    def write(batch: DataFrame, _: int) -> None:
        latest(batch).write.mode("append").parquet(folder)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def append_changes(stream: DataFrame, folder: str, checkpoint: str):
    """Run over what is there with keyed state: append the versions that became newest."""
    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(folder)

    return (newest(stream).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
