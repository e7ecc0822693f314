"""Any schedule of batches, flushes and compactions reads like a dict."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.model import Config
from tidelog.operators import compaction, ordering, reads
from tidelog.plans.store import Busy, Store
from tidelog.sources import folders, manifest

CONFIG = Config(memtable_bytes=200, memtables_per_flush=2, block_bytes=64, level0_trigger=3)


def _batch(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal long, key string, value string")


def test_schedule_equals_dict(spark, tmp_path):
    rng, want, path = random.Random(3), {}, str(tmp_path / "store")
    store = Store(spark, path, CONFIG)
    for step in range(3):
        rows = [(f"key{rng.randint(0, 15)}", rng.choice(["", None, f"v{step}-{i}"])) for i in range(25)]
        store.put(_batch(spark, rows))
        want |= dict(rows)
        gone = [(f"key{rng.randint(0, 20)}", None) for _ in range(3)]
        store.delete(_batch(spark, gone).drop("value"))
        want |= dict(gone)
        if step < 2:
            store.flush()
    live = {k: v for k, v in want.items() if v}
    assert {r.key: r.value for r in reads.live(store.log()).collect()} == live
    for key in ("key1", "key16", "absent"):
        got = store.get(key).first()
        assert got.value == (want.get(key) or None) and (got.status == 0) == bool(want.get(key))
    probes = spark.createDataFrame([(k,) for k in [*live, "absent", "absent"]], "key string")
    got = store.multi_get(probes).collect()
    assert len(got) == len(live) + 2 and all((r.value or None) == live.get(r.key) for r in got)
    store.flush()
    again = Store(spark, path, CONFIG)
    assert again.seq == store.seq and {r.key: r.value for r in reads.live(again.log()).collect()} == live
    before = again.catalogue().count()
    again.vacuum()
    assert again.catalogue().count() == before and {r.key: r.value for r in reads.live(again.log()).collect()} == live
    level1 = again.catalogue().where("level = 1").orderBy("smallest_key").collect()
    assert all(a.largest_key < b.smallest_key for a, b in zip(level1, level1[1:]))


def test_unfinished_commit_and_unflushed_rows_are_invisible(spark, tmp_path):
    path = str(tmp_path / "store")
    store = Store(spark, path, CONFIG)
    store.put(_batch(spark, [("a", "1")]))
    store.flush()
    orphan = spark.createDataFrame([("a", "stale", 0, 99)], "key string, value string, op int, seq long").withColumn("file", F.lit(0))
    store._write(orphan, "file", 0)  # files without an edit
    store.put(_batch(spark, [("b", "2")]))
    again = Store(spark, path, CONFIG)
    assert {r.key: r.value for r in reads.live(again.log()).collect()} == {"a": "1"}
    again.put(_batch(spark, [("c", "3")]))
    again.flush()
    assert {r.key: r.value for r in reads.live(Store(spark, path, CONFIG).log()).collect()} == {"a": "1", "c": "3"}


def test_full_memtables_flush_by_themselves(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), Config(memtable_bytes=100, memtables_per_flush=2, level0_trigger=100))
    want = {}
    for step in range(5):
        rows = [(f"key{step}{i}", "v" * 5) for i in range(10)]  # ten bytes each: a memtable a batch
        store.put(_batch(spark, rows))
        want |= dict(rows)
        # the newest memtable is still written to, so two are full with the third batch
        assert store.catalogue().count() == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}[step]
        assert {r.key: r.value for r in reads.live(store.log()).collect()} == want
    assert store.memory.count() == 10 and store.memory_bytes == 100


def test_scan_seek_and_prefix(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), Config(memtable_bytes=60, memtables_per_flush=2, level0_trigger=4))
    rows = [(w, str(i)) for i, w in enumerate(["ap", "apple", "b", "angel", "Ana", "apple", "", "zoo", "b", "ap"] * 3)]
    for a in range(0, 30, 7):
        store.put(_batch(spark, rows[a:a + 7]))
    log = [(r.key, r.seq) for r in store.log().collect()]
    order = sorted(log, key=lambda r: (r[0], -r[1]))
    assert [(r.key, r.seq, r.position) for r in store.scan().collect()] == [(*r, i) for i, r in enumerate(order)]
    assert [(r.key, r.seq) for r in store.scan("apple", reverse=True).collect()] == [r for r in order[::-1] if r[0] >= "apple"]
    assert store.seek("apq").first().key == "b" and store.seek("zz").count() == 0 and store.seek(last=True).first().key == "zoo"
    assert {r.key for r in store.prefix("ap", newest_only=True).collect()} == {"ap", "apple"}
    assert {r.key for r in store.prefix("").collect()} == {k for k, _ in log} and store.prefix("Ap").count() == 0


def test_old_versions_stay_readable(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), CONFIG)
    states, want = {}, {}
    for step in range(4):
        rows = [(f"key{i % 7}", f"v{step}-{i}") for i in range(20)]
        store.put(_batch(spark, rows))
        store.flush()
        want |= dict(rows)
        states[store.edit_id - 1] = dict(want)
    first = min(states)
    store.vacuum(retained_from=first)
    for version, state in states.items():
        assert {r.key: r.value for r in reads.live(store.snapshot(version)).collect()} == state
    assert store.vacuum() and {r.key: r.value for r in reads.live(store.log()).collect()} == want
    # the manifest goes out as JSON and comes back
    documents = store.manifest_json()
    again = manifest.literal_edits(spark, manifest.split_documents("".join(documents)))
    ids = lambda df: sorted((r.sst_id, r.level) for r in df.collect())
    assert ids(manifest.replay(again)) == ids(store.catalogue())


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    path = str(tmp_path / "store")
    one, two = Store(spark, path, CONFIG), Store(spark, path, CONFIG)
    one.put(_batch(spark, [("a", "1")]))
    two.put(_batch(spark, [("b", "2")]))
    one.flush()
    with pytest.raises(Busy):
        two.flush()
    again = Store(spark, path, CONFIG)
    again.put(two.memory.select((F.col("seq") - 1).alias("ordinal"), "key", "value"))
    again.flush()
    assert {r.key: r.value for r in reads.live(Store(spark, path, CONFIG).log()).collect()} == {"a": "1", "b": "2"}
    # a writer that died after its claim keeps others out until the store is recovered; what it wrote goes
    dead = Store(spark, path, CONFIG)
    folders.claim(spark, f"{path}/claims/{dead.edit_id}")
    spark.range(1).write.parquet(f"{path}/data/edit={dead.edit_id}/sst_id=77")
    late = Store(spark, path, CONFIG)
    late.put(_batch(spark, [("c", "3")]))
    with pytest.raises(Busy):
        late.flush()
    late.vacuum()
    assert f"edit={dead.edit_id}" in folders.names(spark, f"{path}/data")
    Store(spark, path, CONFIG, recover=True).vacuum()
    assert f"edit={dead.edit_id}" not in folders.names(spark, f"{path}/data")
    late.flush()
    assert {r.key for r in reads.live(Store(spark, path, CONFIG).log()).collect()} == {"a", "b", "c"}


def test_a_failed_commit_frees_its_claim(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), CONFIG)
    store.put(_batch(spark, [("a", "1")]))
    with pytest.raises(Exception):
        store._commit(store.memory, "no such column", 0, [])
    store.flush()
    assert store.get("a").first().value == "1"


def test_closure_grows_to_a_fixed_point(spark):
    files = spark.createDataFrame([(1, 0, "c", "d"), (2, 0, "d", "f"), (3, 0, "f", "h"), (4, 0, "x", "z"), (5, 1, "a", "b"), (6, 1, "g", "k")],
                                  "sst_id long, level int, smallest_key string, largest_key string")
    closure = compaction.overlap_closure(files)
    assert sorted(r.sst_id for r in closure.collect()) == [1, 2, 3]
    assert [r.sst_id for r in compaction.next_level(files, closure).collect()] == [6]
    assert compaction.overlap_closure(files.where("level = 1")).count() == 0


def test_order_with_one_hot_key(spark):
    rows = [("hot", i) for i in range(400)] + [(f"k{i}", 1000 + i) for i in range(100)]
    log = spark.createDataFrame(rows, "key string, seq long")
    want = sorted(rows, key=lambda r: (r[0], -r[1]))
    got = ordering.positions(log, ranges=7).orderBy("position").collect()
    assert [(r.key, r.seq, r.position) for r in got] == [(*r, i) for i, r in enumerate(want)]
    back = ordering.positions(log, ranges=40, reverse=True).collect()
    assert {(r.key, r.seq): r.position for r in back} == {r: len(want) - 1 - i for i, r in enumerate(want)}
    for ranges in (1, 7, 40):
        age = {(r.key, r.seq): r.age for r in reads.history(log).collect()} if ranges == 1 else {
            (r.key, r.seq): r.age for r in ordering.ages(log, ranges).collect()}
        assert age == {r: sum(k == r[0] and s >= r[1] for k, s in rows) for r in rows}
    near = {(r.key, r.seq): (r.next_key, r.next_seq) for r in ordering.neighbours(log, ranges=7).collect()}
    assert all(near[a] == b for a, b in zip(want, want[1:])) and near[want[-1]] == (None, None)
    assert ordering.neighbours(log.limit(0)).count() == 0
