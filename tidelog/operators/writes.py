"""Batches of puts and deletes as rows that follow a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.model import DELETE, PUT
from tidelog.sources.tables import normalised


def rows(log: DataFrame, batch: list[tuple[str, str | None]]) -> DataFrame:
    """A small batch given as literals: (ordinal, key, value)."""
    structs = [F.struct(F.lit(i).cast("long").alias("ordinal"), F.lit(k).alias("key"), F.lit(v).cast("string").alias("value"))
               for i, (k, v) in enumerate(batch)]
    return log.sparkSession.range(1).select(F.inline(F.array(*structs)))


def _appended(log: DataFrame, batch: DataFrame, op: int, after: int | None) -> DataFrame:
    """``batch`` (ordinal, key[, value]) takes the sequence numbers that follow the log's newest, in order."""
    if after is None:
        after = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    value = F.col("value") if op == PUT else F.lit(None).cast("string")
    new = batch.select("key", value.alias("value"), F.lit(op).alias("op"), (F.lit(after) + 1 + F.col("ordinal")).alias("seq"))
    return log.unionByName(normalised(new))


def put(log: DataFrame, batch: DataFrame, after: int | None = None) -> DataFrame:
    """Later puts of a key win; an empty value deletes.  ``after``: newest sequence number, if it is known."""
    return _appended(log, batch, PUT, after)


def delete(log: DataFrame, batch: DataFrame, after: int | None = None) -> DataFrame:
    """Tombstones, whether or not the keys exist."""
    return _appended(log, batch, DELETE, after)
