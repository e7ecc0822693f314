"""Operation logs read from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.entries import normal_op
from tidelog.model import DELETE, PUT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalised(ops: DataFrame) -> DataFrame:
    """(key, value, op, seq) with empty puts as tombstones; ``ops`` needs these columns."""
    op = normal_op("value", "op")
    return ops.select("key", F.when(op == PUT, F.col("value")).alias("value"), op.cast("int").alias("op"),
                      F.col("seq").cast("long").alias("seq"))


def events_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw operations of ``events``: errors are deletes, every tenth view puts nothing."""
    id_, kind = F.col("event_id"), F.col("event_type")
    value = F.when(kind == "error", None).when((kind == "view") & (id_ % 10 == 0), F.lit("")).otherwise(F.concat(kind, F.lit(":"), id_))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("key"), "user_id").alias("key"), value.alias("value"),
        F.when(kind == "error", DELETE).otherwise(PUT).alias("op"), (id_ + 1).alias("seq"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(events_ops(spark, sf_dir))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One put for each order; the order key numbers the operations."""
    return normalised(table(spark, sf_dir, "orders").select(
        F.concat(F.lit("key"), "o_orderkey").alias("key"), F.concat(F.lit("value"), "o_custkey").alias("value"),
        F.lit(PUT).alias("op"), (F.col("o_orderkey") + 1).alias("seq")))


def pages_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large values: url -> html."""
    return normalised(table(spark, sf_dir, "pages").select(
        F.col("url").alias("key"), F.col("html").alias("value"), F.lit(PUT).alias("op"), (F.col("page_id") + 1).alias("seq")))
