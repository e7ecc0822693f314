"""Global positions and neighbours in (key, newest first) without sorting in one task.

Rows are dealt to ranges of the order by fixed boundaries, ranked inside their
range, and offset by the sizes of the ranges before.  The boundaries come from a
bounded sample (the rows of smallest hash), so they are the same in every run;
they include the sequence number, so a key with very many versions is split too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PER_RANGE = 32


def looked_up(rows: DataFrame, bounds: list, kind: str, **at: Column) -> DataFrame:
    """``rows`` with a column for each of ``at``: how many of the sorted ``bounds`` are at or before it, in two steps of some root of their number."""
    if not bounds:
        return rows.select(*rows.columns, *(F.lit(0).alias(name) for name in at))
    step = max(1, round(len(bounds) ** 0.5))
    edges = rows.sparkSession.createDataFrame([(bounds, bounds[step - 1::step])], f"edges array<{kind}>, coarse array<{kind}>")

    def own(x):
        near = F.size(F.filter("coarse", lambda e: e <= x)) * step
        return near + F.size(F.filter(F.slice("edges", near + 1, step), lambda e: e <= x))

    return rows.crossJoin(F.broadcast(edges)).select(*rows.columns, *(own(x).alias(name) for name, x in at.items()))  # one row


def _ranged(log: DataFrame, ranges: int | None) -> DataFrame:
    """The log with ``range``: how many boundaries are at or before the entry."""
    spark = log.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.struct(F.col("key"), (-F.col("seq")).alias("age"))
    sample = (log.select(at.alias("at"), F.xxhash64("key", "seq").alias("h")).orderBy("h").limit(n * _PER_RANGE)
              .agg(F.sort_array(F.collect_list("at")).alias("at")).first().at)
    bounds = [(b.key, b.age) for b in sample[_PER_RANGE::_PER_RANGE]]
    return looked_up(log, bounds, "struct<key:string,age:long>", range=at)


def key_bounds(keys: DataFrame, ranges: int) -> list[str]:
    """Boundaries that deal distinct ``keys`` to ``ranges`` of about the same size, from a bounded sample."""
    sample = (keys.where("key is not null").select("key", F.xxhash64("key").alias("h")).orderBy("h").limit(ranges * _PER_RANGE)
              .agg(F.sort_array(F.collect_list("key")).alias("at")).first().at)
    return sample[_PER_RANGE::_PER_RANGE]


def _inside():
    return Window.partitionBy("range").orderBy("key", F.desc("seq"))


def _with_offsets(placed: DataFrame) -> DataFrame:
    """Adds ``before``, the rows in earlier ranges, and ``total``: from a table of one row for each range."""
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"),
                          F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    return placed.join(F.broadcast(before), "range")


def positions(log: DataFrame, ranges: int | None = None, reverse: bool = False) -> DataFrame:
    """The log with ``position``: 0 for the first entry in (key, newest first), or for the last with ``reverse``."""
    placed = _with_offsets(_ranged(log, ranges))
    at = F.col("before") + F.row_number().over(_inside()) - 1
    return placed.withColumn("position", F.col("total") - 1 - at if reverse else at).drop("range", "before", "total")


def ages(log: DataFrame, ranges: int | None = None) -> DataFrame:
    """The log with ``age``: 1 is a key's newest version.  A key's versions may lie in several ranges."""
    placed = _ranged(log, ranges)
    ends = placed.groupBy("range", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("range").agg(
        F.min("key").alias("first"), F.max_by(F.struct("key", "n"), "key").alias("last"))
    # versions of a range's first key in the ranges before it, which end with that key: a row a range
    earlier = ends.select(F.col("range").alias("r"), F.col("last.key").alias("k"), F.col("last.n").alias("n"))
    carried = (ends.join(earlier, (F.col("first") == F.col("k")) & (F.col("r") < F.col("range")))
               .groupBy("range", F.col("first").alias("key")).agg(F.sum("n").alias("carried")))
    rank = F.row_number().over(Window.partitionBy("range", "key").orderBy(F.desc("seq")))
    return (placed.withColumn("rank", rank).join(F.broadcast(carried), ["range", "key"], "left")
            .select(*log.columns, (F.col("rank") + F.coalesce("carried", F.lit(0))).alias("age")))


def neighbours(log: DataFrame, ranges: int | None = None) -> DataFrame:
    """(key, seq, next_key, next_seq, prev_key, prev_seq) of every entry; null at the ends."""
    me = F.struct("key", "seq")
    placed = (_ranged(log.select("key", "seq"), ranges)
              .withColumn("next", F.lead(me).over(_inside())).withColumn("prev", F.lag(me).over(_inside())))
    # the ends of each range see the neighbouring ranges: one row a range
    ends = placed.groupBy("range").agg(F.min_by(me, F.struct("key", -F.col("seq"))).alias("first"),
                                       F.max_by(me, F.struct("key", -F.col("seq"))).alias("last"))
    over = Window.orderBy("range")
    ends = ends.select("range", F.lead("first").over(over).alias("after"), F.lag("last").over(over).alias("ahead"))
    both = placed.join(F.broadcast(ends), "range")
    nxt, prv = F.coalesce("next", "after"), F.coalesce("prev", "ahead")
    return both.select("key", "seq", nxt.key.alias("next_key"), nxt.seq.alias("next_seq"),
                       prv.key.alias("prev_key"), prv.seq.alias("prev_seq"))
