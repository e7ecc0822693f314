"""Memtables, sorted files and their catalogue, as columns and aggregates of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidelog.functions.entries import entry_bytes, payload_bytes
from tidelog.model import DELETED, FOUND, NOT_FOUND, PUT
from tidelog.operators import ordering
from tidelog.operators.cuts import greedy, greedy_within
from tidelog.sources import folders

#: Catalogue rows (files, not data) up to which the catalogue is broadcast.
SMALL_CATALOGUE = 200_000
#: Ranges of keys in which files are looked up.
KEY_RANGES = 256
#: Pairs of a key and a file for each task of such a lookup, and most tasks.
PAIRS, MOST_TASKS = 2_000_000, 1024
_OFFSET_BYTES, _TRAILER_BYTES = 16, 16


def memtables(log: DataFrame, limit: int) -> DataFrame:
    """The log with ``memtable_id``: a memtable ends with the operation that fills it to ``limit`` bytes."""
    return greedy(log.withColumn("n_bytes", payload_bytes()), "seq", "n_bytes", limit, "memtable_id").drop("n_bytes")


def flush_batches(cut: DataFrame, memtables_per_flush: int) -> DataFrame:
    """(batch_id, n_memtables, n_versions, n_bytes, flushed): memtables are flushed a full batch at a time.

    The newest memtable is still written to, so it is in no full batch.
    """
    per = cut.groupBy("memtable_id").agg(F.count(F.lit(1)).alias("n"), F.sum(payload_bytes()).alias("b"))
    last = per.agg(F.max("memtable_id").alias("active"))
    batch = F.floor(F.col("memtable_id") / memtables_per_flush)
    return (per.crossJoin(F.broadcast(last)).groupBy(batch.alias("batch_id"))  # one row
            .agg(F.count(F.lit(1)).alias("n_memtables"), F.sum("n").alias("n_versions"), F.sum("b").alias("n_bytes"),
                 (F.count_if(F.col("memtable_id") < F.col("active")) == memtables_per_flush).alias("flushed")))


def flushed(cut: DataFrame, memtables_per_flush: int) -> DataFrame:
    """The versions that outlive a restart: those in flushed batches.  There is no write-ahead log."""
    active = cut.agg(F.coalesce(F.max("memtable_id"), F.lit(0))).first()[0]
    return cut.where(F.col("memtable_id") < active // memtables_per_flush * memtables_per_flush)


def catalogue(files: DataFrame, file_id: str = "memtable_id") -> DataFrame:
    """One row a file: key range, sequence range, versions and payload bytes; column ``level`` is kept if there is one."""
    keys = [F.col(file_id).alias("sst_id"), *([F.col("level")] if "level" in files.columns else [])]
    return files.groupBy(*keys).agg(
        F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"), F.count(F.lit(1)).alias("n_entries"), F.sum(payload_bytes()).alias("n_bytes"))


def block_layout(files: DataFrame, block_bytes: int, file_id: str = "memtable_id") -> DataFrame:
    """(sst_id, block_id, smallest_key, largest_key, n_entries, size, start_offset) of the blocks of each file.

    A block ends with the entry that fills it, counting an offset record for each entry; its trailer follows.
    """
    sized = files.select(F.col(file_id).alias("sst_id"), "key", "seq", (entry_bytes() + _OFFSET_BYTES).alias("n_bytes"))
    cut = greedy_within(sized, "sst_id", ["key", "-seq"], "n_bytes", block_bytes, "block_id")
    blocks = cut.groupBy("sst_id", "block_id").agg(
        F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.count(F.lit(1)).alias("n_entries"),
        (F.sum("n_bytes") + _TRAILER_BYTES).alias("size"))
    before = F.sum("size").over(Window.partitionBy("sst_id").orderBy("block_id")) - F.col("size")
    return blocks.withColumn("start_offset", before)


def tiers(cut: DataFrame) -> DataFrame:
    """The log with ``tier``: 0 active memtable, 1 immutable ones, 2 level 0, 3 level 1, by age of the memtable."""
    last = cut.agg(F.max("memtable_id").alias("last"))
    age = F.col("last") - F.col("memtable_id")
    tier = F.when(age == 0, 0).when(age <= 2, 1).when(age <= 5, 2).otherwise(3)
    return cut.crossJoin(F.broadcast(last)).withColumn("tier", tier).drop("last")


def covering(keys: DataFrame, files: DataFrame, how: str = "inner") -> DataFrame:
    """``keys``, which are distinct, joined with the files whose key range covers them.

    Keys are dealt to ranges and a file to all ranges that it meets, so a key is
    compared with the files of its range: those that cover the whole range, which
    are results, and those that begin or end in it.  Files are broadcast when they
    are counted to be few.
    """
    keys, files = folders.written(keys), folders.written(files)
    bounds = ordering.key_bounds(keys, KEY_RANGES)
    # keys are few bytes, yet each may meet many files: as many tasks as pairs ask for
    tasks = min(max(keys.count() * files.count() // PAIRS, 1), MOST_TASKS)
    placed = ordering.looked_up(keys.repartition(tasks, "key"), bounds, "string", key_range=F.col("key"))
    met = (ordering.looked_up(files, bounds, "string", first=F.col("smallest_key"), last=F.col("largest_key"))
           .select(*files.columns, F.explode(F.sequence("first", "last")).alias("file_range")))
    met = F.broadcast(met) if met.count() <= SMALL_CATALOGUE else met
    covers = (F.col("key_range") == F.col("file_range")) & F.col("key").between(F.col("smallest_key"), F.col("largest_key"))
    return placed.join(met, covers, how).drop("key_range", "file_range")


def candidates(probes: DataFrame, files: DataFrame) -> DataFrame:
    """(key, sst_id, level) of the files whose key range covers a probe key; the rest are never opened.

    Levels beyond 0 do not overlap, so they give one file a key.
    """
    own = files.select("sst_id", "level", "smallest_key", "largest_key")
    return covering(probes.select("key").distinct(), own).select("key", "sst_id", "level")


def tiered_get(tiered: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, status, value, tier): the first tier that knows a key answers; within one the newest version does."""
    wanted = tiered.join(probes.select("key").distinct(), "key", "left_semi")
    best = wanted.groupBy("key").agg(F.min_by(F.struct("value", "op", "tier"), F.struct("tier", -F.col("seq"))).alias("v"))
    status = F.when(F.col("v").isNull(), NOT_FOUND).when(F.col("v.op") == PUT, FOUND).otherwise(DELETED)
    return probes.select("key").distinct().join(best, "key", "left").select(
        "key", status.alias("status"), F.col("v.value").alias("value"), F.col("v.tier").alias("tier"))
