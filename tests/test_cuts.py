import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.operators import cuts


def loop(sizes, limit):
    out, number, run = [], 0, 0
    for s in sizes:
        out.append(number)
        run += s
        if run >= limit:
            number, run = number + 1, 0
    return out


def folded(sizes, limit, block):
    parts = [np.array(sizes[a:a + block]) for a in range(0, len(sizes), block)]
    return parts, [cuts.block_function(p, limit) for p in parts], [int(p.sum()) for p in parts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=60), st.integers(1, 40), st.integers(1, 20), st.integers(1, 5))
def test_blocks_compose_to_the_fold(sizes, limit, block, fan):
    parts, functions, totals = folded(sizes, limit, block)
    got, open_, number = [], 0, 0
    for p, f, total in zip(parts, functions, totals):
        got += (cuts.cut_rows(p, limit, open_) + number).tolist()
        end, times = cuts.applied(f, total, np.array([open_]))
        open_, number = int(end[0]), number + int(times[0])
    assert got == loop(sizes, limit)
    # several functions in one give the same for every size that may be open
    for a in range(0, len(parts), fan):
        one = cuts.composed(functions[a:a + fan], totals[a:a + fan], limit)
        for start in range(limit):
            end, times = start, 0
            for f, total in zip(functions[a:a + fan], totals[a:a + fan]):
                e, t = cuts.applied(f, total, np.array([end]))
                end, times = int(e[0]), times + int(t[0])
            e, t = cuts.applied(one, sum(totals[a:a + fan]), np.array([start]))
            assert (int(e[0]), int(t[0])) == (end, times)


def test_a_block_of_many_limits_has_few_steps():
    sizes = np.random.default_rng(1).integers(60, 140, 1 << 20)
    limit = int(sizes.sum()) // cuts.LIMITS
    least, _, _ = cuts.block_function(sizes, limit)
    assert len(least) <= len(sizes) / cuts.LIMITS * 1.1


def test_greedy_over_many_blocks(spark):
    rows = spark.range(500).select(F.col("id").alias("o"), (F.col("id") * 7919 % 23).alias("s"))
    want = loop([i * 7919 % 23 for i in range(500)], 40)
    for block_rows in (2, 16, 600, None):  # 250 blocks need three rounds of sixteen
        got = cuts.greedy(rows, "o", "s", 40, "cut", block_rows=block_rows).orderBy("o").collect()
        assert [r.cut for r in got] == want


def test_greedy_of_nothing(spark):
    assert cuts.greedy(spark.createDataFrame([], "o long, s long"), "o", "s", 40, "cut").count() == 0
