"""Compaction as queries: which files, what survives, how the output is split."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.entries import payload_bytes
from tidelog.model import DELETE
from tidelog.operators.cuts import greedy
from tidelog.operators.ordering import positions
from tidelog.operators.reads import latest
from tidelog.sources import folders
from tidelog.operators.tables import covering


def scores(files: DataFrame, level0_trigger: int) -> DataFrame:
    """(level, n_files, score): only level 0 is ever due, by its number of files."""
    score = F.when(F.col("level") == 0, F.count(F.lit(1)) / level0_trigger).otherwise(0.0)
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("n_files"), score.alias("score"))


def pick_level(scored: DataFrame) -> DataFrame:
    """(level, score, due): the highest score, the deeper level on ties; no row without files."""
    best = F.max_by(F.struct("level", "score"), F.struct("score", "level")).alias("b")
    return scored.agg(best).where("b is not null").select("b.level", "b.score", (F.col("b.score") >= 1).alias("due"))


def _reach(low: str, high: str):
    """What the range from ``low`` to ``high`` grows to over the files of a task, batch by batch."""
    def run(batches):
        a, b = low, high
        for batch in batches:
            files = list(zip(*(batch.column(i).to_pylist() for i in range(2))))
            for first, last in sorted(files):
                if first <= b and last >= a:
                    b = max(b, last)
            for first, last in sorted(files, key=lambda f: f[1], reverse=True):
                if first <= b and last >= a:
                    a = min(a, first)
        yield pa.RecordBatch.from_pydict({"low": [a], "high": [b]})

    return run


def overlap_closure(files: DataFrame) -> DataFrame:
    """The level-0 files to compact together: the oldest, and whatever overlaps the range so far, until it stays.

    Catalogue rows only, written once; in each round tasks extend the range over their
    own files as far as these go, and rounds end when it no longer grows.
    """
    level0 = folders.written(files.where("level = 0"))
    seed = level0.agg(F.min_by(F.struct("smallest_key", "largest_key"), "sst_id").alias("s")).first().s
    if seed is None:
        return level0
    low, high = seed
    while True:
        reached = level0.select("smallest_key", "largest_key").mapInArrow(_reach(low, high), "low string, high string")
        found = reached.agg(F.min("low"), F.max("high")).first()
        if (found[0], found[1]) == (low, high):
            return level0.where((F.col("largest_key") >= low) & (F.col("smallest_key") <= high))
        low, high = found


def next_level(files: DataFrame, inputs: DataFrame, level: int = 1) -> DataFrame:
    """Files of ``level`` whose range meets that of the inputs."""
    span = inputs.agg(F.min("smallest_key").alias("low"), F.max("largest_key").alias("high"))
    return (files.where(F.col("level") == level).join(F.broadcast(span), (F.col("largest_key") >= F.col("low")) & (F.col("smallest_key") <= F.col("high")))
            .select(*files.columns))


def at_base(keys: DataFrame, deeper: DataFrame) -> DataFrame:
    """``keys`` with ``base``: no deeper file's range covers the key."""
    if deeper.isEmpty():
        return keys.withColumn("base", F.lit(True))
    covered = covering(keys.select("key").distinct(), deeper.select("smallest_key", "largest_key"), "left_semi")
    return keys.join(covered.withColumn("deeper", F.lit(True)), "key", "left").select(*keys.columns, F.col("deeper").isNull().alias("base"))


def merge(inputs: DataFrame, deeper: DataFrame | None = None) -> DataFrame:
    """The newest version of each key; tombstones stay only where a deeper file may hold an older one."""
    newest = latest(inputs)
    if deeper is None:
        return newest.where(F.col("op") != DELETE)
    return at_base(newest, deeper).where((F.col("op") != DELETE) | ~F.col("base")).select("key", "value", "op", "seq")


def stats(inputs: DataFrame, deeper: DataFrame | None = None) -> DataFrame:
    """One row: versions read, superseded, dropped as tombstones, and kept."""
    one = inputs.agg(F.count(F.lit(1)).alias("n_in"))
    two = latest(inputs).agg(F.count(F.lit(1)).alias("n_keys"))
    three = merge(inputs, deeper).agg(F.count(F.lit(1)).alias("n_kept"))
    return (one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three))  # one row each
            .select("n_in", (F.col("n_in") - F.col("n_keys")).alias("n_superseded"),
                    (F.col("n_keys") - F.col("n_kept")).alias("n_tombstones_dropped"), "n_kept"))


def split(merged: DataFrame, limit: int) -> DataFrame:
    """The merged rows with ``file_no``: in key order a file ends with the row that fills it."""
    placed = positions(merged).withColumn("n_bytes", payload_bytes())
    return greedy(placed, "position", "n_bytes", limit, "file_no").drop("position", "n_bytes")
