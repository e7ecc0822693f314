"""Greedy cuts: a running size starts anew after the row that reaches a limit.

This is a fold, yet it need not run in one task.  Rows are dealt to blocks of a
span of their dense ordinal that holds many limits.  A block is a function from
the size open at its start to the size open at its end, and to the number of cuts
inside: a step for each row that may be the first to reach the limit, so a block
of sixteen limits has a sixteenth of its rows as steps at most.  Blocks compute
theirs in parallel, tasks compose them ``FAN`` at a time until one is left, and the
open sizes come back down the same way; the driver sees no function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.sources import folders

#: Least and most rows of a block, and the limits that it holds between them.
BLOCK_ROWS, MOST_ROWS, LIMITS = 1 << 18, 1 << 23, 16
#: Blocks composed by one task.
FAN = 16
#: Parts of a block: a row compares itself with the cuts that start in its part only.
PARTS = 64
#: Parts and cuts up to which they are broadcast; both are counted.
SMALL = 200_000
FUNCTION = "block long, total long, least array<long>, end array<long>, cuts array<long>"


def cut_rows(size: np.ndarray, limit: int, open_: int = 0) -> np.ndarray:
    """Per row its cut, from 0, when ``open_`` is already in the first one."""
    total = np.cumsum(size)
    starts, at, base = [], 0, -open_
    while True:
        at = int(np.searchsorted(total, base + limit)) + 1
        if at >= len(size):
            break
        starts.append(at)
        base = total[at - 1]
    out = np.zeros(len(size), np.int64)
    out[starts] = 1
    return np.cumsum(out)


def block_function(size: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps (least open size, open size at the end, cuts) of a block.

    Without a cut the size at the end is the open one plus the block's total: marked -1.
    """
    total = np.concatenate([[0], np.cumsum(size)])
    n = len(size)
    # open size r: the first cut comes with the first row whose total reaches limit - r
    row = np.arange(1, min(n, int(np.searchsorted(total, limit))) + 1)
    row = row[total[row] > total[row - 1]]
    # all starts go on in step, from cut to cut
    at, cuts = row.copy(), np.ones(len(row), np.int64)
    live = np.arange(len(row))
    while len(live):
        to = np.searchsorted(total, total[at[live]] + limit)
        live, to = live[to <= n], to[to <= n]
        at[live] = to
        cuts[live] += 1
    least, ends = np.maximum(limit - total[row], 0)[::-1], (total[n] - total[at])[::-1]
    cuts = cuts[::-1]
    if not len(least) or least[0] > 0:
        least, ends, cuts = np.append(0, least), np.append(-1, ends), np.append(0, cuts)
    new = np.concatenate([[True], (ends[1:] != ends[:-1]) | (cuts[1:] != cuts[:-1])])
    return least[new], ends[new], cuts[new]


def applied(function: tuple, total: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(open sizes at the end, cuts) of a block for open sizes at its start."""
    least, end, cuts = function
    k = np.searchsorted(least, open_, "right") - 1
    return np.where(end[k] < 0, open_ + total, end[k]), cuts[k]


def composed(functions: list[tuple], totals: list[int], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The function of several blocks in a row."""
    least, end, cuts = functions[0]
    whole = totals[0]
    for f, total in zip(functions[1:], totals[1:]):
        # where the first block cuts, its end is a number; where it does not, the end grows with the start
        same = int((end < 0).sum())  # at most the first step
        starts = np.unique(np.concatenate([least, *([np.maximum(f[0] - whole, 0)] if same else [])]))
        if same:
            starts = starts[(starts < (least[1] if len(least) > 1 else limit)) | np.isin(starts, least)]
        k = np.searchsorted(least, starts, "right") - 1
        middle = np.where(end[k] < 0, starts + whole, end[k])
        j = np.searchsorted(f[0], middle, "right") - 1
        open_ = (end[k] < 0) & (f[1][j] < 0)
        after = np.where(open_, -1, np.where(f[1][j] < 0, middle + total, f[1][j]))
        number = cuts[k] + f[2][j]
        new = np.concatenate([[True], (after[1:] != after[:-1]) | (number[1:] != number[:-1])])
        least, end, cuts = starts[new], after[new], number[new]
        whole += total
    return least, end, cuts


def _functions(table: pa.Table):
    table = table.sort_by("block")
    columns = [table.column(c).to_pylist() for c in ("least", "end", "cuts")]
    return table.column("block").to_pylist(), [tuple(map(np.array, f)) for f in zip(*columns)], table.column("total").to_pylist()


def _row(block: int, total: int, function: tuple) -> pa.Table:
    return pa.table({"block": pa.array([block]), "total": pa.array([total]), **{
        c: pa.array([x.tolist()], pa.list_(pa.int64())) for c, x in zip(("least", "end", "cuts"), function)}})


def _opens(functions: DataFrame, n_blocks: int, limit: int) -> DataFrame:
    """(block, open, first): the size open at each block's start, and the number of its first cut."""
    group = F.floor(F.col("block") / FAN)

    def compose(table: pa.Table) -> pa.Table:
        blocks, own, totals = _functions(table)
        return _row(blocks[0] // FAN, sum(totals), composed(own, totals, limit))

    def descend(table: pa.Table, at: pa.Table) -> pa.Table:
        blocks, own, totals = _functions(table)
        open_, first = (at.column(c)[0].as_py() for c in ("open", "first")) if at.num_rows else (0, 0)
        out = []
        for block, f, total in zip(blocks, own, totals):
            out.append((block, open_, first))
            end, cuts = applied(f, total, np.array([open_]))
            open_, first = int(end[0]), first + int(cuts[0])
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out)], names=["block", "open", "first"])

    n_groups = -(-n_blocks // FAN)
    if n_groups > 1:
        upper = folders.written(functions.groupBy(group.alias("group")).applyInArrow(compose, FUNCTION))
        above = _opens(upper, n_groups, limit)
    else:
        above = functions.sparkSession.createDataFrame([(0, 0, 0)], "block long, open long, first long")
    return folders.written(functions.groupBy(group).cogroup(above.groupBy("block")).applyInArrow(descend, "block long, open long, first long"))


def greedy(rows: DataFrame, ordinal: str, size: str, limit: int, into: str, block_rows: int | None = None) -> DataFrame:
    """``rows`` with ``into``: the number of each row's cut, in the order of a unique ``ordinal``.

    Only (ordinal, size) is shuffled.  A block's cuts come back, for each of its parts,
    as the ordinals at which they start, and the rows look theirs up without moving.
    Blocks hold ``block_rows`` ordinals, or as many as some sixteen limits take.
    """
    spark = rows.sparkSession
    narrow = rows.select(F.col(ordinal).cast("long").alias("o"), F.col(size).cast("long").alias("s"))
    top, n, whole = narrow.agg(F.max("o"), F.count(F.lit(1)), F.sum("s")).first()
    n_cuts = (whole or 0) // limit + 1
    if block_rows is None:
        block_rows = min(max(BLOCK_ROWS, LIMITS * (n or 1) // n_cuts), MOST_ROWS)
    n_blocks = (top or 0) // block_rows + 1
    part_rows = -(-block_rows // PARTS)
    part = F.floor(F.col(ordinal) / block_rows) * PARTS + F.floor(F.pmod(F.col(ordinal), F.lit(block_rows)) / part_rows)
    blocks = narrow.withColumn("block", F.floor(F.col("o") / block_rows))

    def function(table: pa.Table) -> pa.Table:
        sizes = table.sort_by("o").column("s").to_numpy()
        return _row(table.column("block")[0].as_py(), int(sizes.sum()), block_function(sizes, limit))

    if n_blocks > 1:
        starts = _opens(folders.written(blocks.groupBy("block").applyInArrow(function, FUNCTION)), n_blocks, limit)
    else:
        starts = spark.createDataFrame([(0, 0, 0)], "block long, open long, first long")

    def numbered(table: pa.Table, start: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64()))],
                            names=["cut_part", "first_cut", "starts"])
        table = table.sort_by("o")
        own = cut_rows(table.column("s").to_numpy(), limit, start.column("open")[0].as_py()) + start.column("first")[0].as_py()
        o = table.column("o").to_numpy()
        parts = o // block_rows * PARTS + o % block_rows // part_rows
        begin = np.flatnonzero(np.diff(parts, prepend=parts[0] - 1))
        # those at a part's first row are in its first cut
        at = np.setdiff1d(np.flatnonzero(np.diff(own)) + 1, begin, assume_unique=True)
        offsets = np.searchsorted(at, np.append(begin, len(o))).astype(np.int32)
        return pa.table({"cut_part": pa.array(parts[begin]), "first_cut": pa.array(own[begin]),
                         "starts": pa.ListArray.from_arrays(pa.array(offsets), pa.array(o[at], pa.int64()))})

    told = (blocks.groupBy("block").cogroup(starts.groupBy("block"))
            .applyInArrow(numbered, "cut_part long, first_cut long, starts array<long>"))
    told = F.broadcast(told) if n_blocks * PARTS + n_cuts <= SMALL else told
    own = F.size(F.filter("starts", lambda s: s <= F.col(ordinal)))
    return rows.join(told, part == F.col("cut_part")).select(*rows.columns, (F.col("first_cut") + own).alias(into))


def greedy_within(rows: DataFrame, group: str, order: list[str], size: str, limit: int, into: str) -> DataFrame:
    """``rows`` with the number of each row's cut inside its group, whose rows are bounded by construction."""
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c.lstrip("-"), "descending" if c[0] == "-" else "ascending") for c in order])
        return table.append_column(into, pa.array(cut_rows(table.column(size).to_numpy(), limit)))

    return rows.groupBy(group).applyInArrow(run, schema)
