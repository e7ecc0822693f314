"""Lookups and ordered scans over an operation log.

Newest wins by sequence number, whatever file or tier a version is in, so tiers
are a union and never a search order.  ``latest`` is an aggregate with map-side
partial results: a key with a third of all versions costs one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import DELETED, FOUND, NOT_FOUND, PUT
from tidelog.operators import ordering


def latest(log: DataFrame) -> DataFrame:
    """(key, value, op, seq): the newest version of each key, tombstones included."""
    newest = F.max_by(F.struct("value", "op", "seq"), "seq").alias("v")
    return log.groupBy("key").agg(newest).select("key", "v.value", "v.op", "v.seq")


def live(log: DataFrame) -> DataFrame:
    """(key, value, seq) of the keys whose newest version is a put."""
    return latest(log).where(F.col("op") == PUT).select("key", "value", "seq")


def as_of(log: DataFrame, seq: int | Column) -> DataFrame:
    """The log as it was after operation ``seq``."""
    return log.where(F.col("seq") <= seq)


def history(log: DataFrame) -> DataFrame:
    """Every version with its age: 1 is a key's newest.  A hot key is split like any other range of entries."""
    return ordering.ages(log)


def multi_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """For every row of ``probes`` (key and any more columns), duplicates included: status and value.

    Versions of other keys are dropped before the aggregate; Spark broadcasts the
    distinct probe keys only if they are small.
    """
    wanted = log.join(probes.select("key").distinct(), "key", "left_semi")
    found = latest(wanted).select("key", F.when(F.col("op") == PUT, FOUND).otherwise(DELETED).alias("status"), "value")
    return probes.join(found, "key", "left").withColumn("status", F.coalesce("status", F.lit(NOT_FOUND)))


def multi_get_as_of(log: DataFrame, probes: DataFrame, seq: str = "seq") -> DataFrame:
    """As ``multi_get``, each row of ``probes`` as it was after the operation that its column ``seq`` names.

    Only keys, sequence numbers and operations are ordered; the values are joined by
    key and sequence number, so a key with many versions does not gather its values.
    """
    wanted = probes.select("key", F.col(seq).alias("until")).distinct()
    known = log.join(wanted.select("key").distinct(), "key", "left_semi")
    both = known.select("key", "seq", F.col("seq").alias("own"), "op").unionByName(
        wanted.select("key", F.col("until").alias("seq"), F.lit(None).cast("long").alias("own"), F.lit(None).cast("int").alias("op")))
    before = Window.partitionBy("key").orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    newest = both.withColumn("v", F.max(F.when(F.col("own").isNotNull(), F.struct("own", "op"))).over(before)).where("own is null and v is not null")
    at = newest.select(F.col("key").alias("k"), F.col("seq").alias("until"), F.col("v.own").alias("at"),
                       F.when(F.col("v.op") == PUT, FOUND).otherwise(DELETED).alias("status"))
    values = log.select(F.col("key").alias("value_key"), F.col("seq").alias("value_seq"), "value")
    found = (at.join(values, (F.col("k") == F.col("value_key")) & (F.col("at") == F.col("value_seq")))
             .select("k", "until", "status", "value"))
    return (probes.join(found, (F.col("key") == F.col("k")) & (F.col(seq) == F.col("until")), "left")
            .select(*probes.columns, F.coalesce("status", F.lit(NOT_FOUND)).alias("status"), "value"))


def get(log: DataFrame, key: str) -> DataFrame:
    """One row (key, status, value); the equality reaches the scan."""
    found = log.where(F.col("key") == key).agg(F.max_by(F.struct("value", "op"), "seq").alias("v"))
    status = F.when(F.col("v").isNull(), NOT_FOUND).when(F.col("v.op") == PUT, FOUND).otherwise(DELETED)
    return found.select(F.lit(key).alias("key"), status.alias("status"), F.col("v.value").alias("value"))


def prefix(log: DataFrame, start: str, newest_only: bool = False) -> DataFrame:
    """Versions whose key starts with ``start``: all of them, or the live ones."""
    own = log.where(F.col("key").startswith(start))
    return live(own) if newest_only else own


def key_range(log: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Versions with low <= key < high."""
    if low is not None:
        log = log.where(F.col("key") >= low)
    return log if high is None else log.where(F.col("key") < high)


def seek(log: DataFrame, key: str | None = None, last: bool = False) -> DataFrame:
    """The first entry in (key, newest first) at or after ``key``; the first or last of all without one."""
    own = key_range(log, key)
    return own.orderBy(*((F.desc("key"), F.asc("seq")) if last else (F.asc("key"), F.desc("seq")))).limit(1)


def merged(*logs: DataFrame) -> DataFrame:
    """All versions of several tables."""
    return reduce(DataFrame.unionByName, logs)
