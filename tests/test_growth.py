"""What must not grow with the number of memtables or files."""

from pyspark.sql import functions as F

from tidelog.model import Config
from tidelog.operators import compaction, reads, tables
from tidelog.plans.store import Store
from tidelog.sources import folders

FILES = "sst_id long, level int, smallest_key string, largest_key string"


def test_small_files_share_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), Config(memtable_bytes=50, memtables_per_flush=1000, level0_trigger=1000))
    for step in range(2):
        store.put(spark.range(100).select(F.col("id").alias("ordinal"), F.concat(F.lit("key"), F.col("id") % 20 + 100 * step).alias("key"),
                                          F.concat(F.lit(f"v{step}-"), "id").alias("value")))
        store.flush()
    assert store.catalogue().count() > 30
    assert [len([n for n in folders.names(spark, f"{store.path}/data/edit={e}") if n[0] == "s"]) for e in (1, 2)] == [1, 1]
    want = {f"key{i % 20 + 100 * step}": f"v{step}-{i}" for step in range(2) for i in range(100)}
    assert {r.key: r.value for r in reads.live(store.log()).collect()} == want
    # every other file: more runs of numbers than one
    some = store.catalogue().where("sst_id % 2 = 0")
    seqs = [r.seq for r in store._read(some).collect()]
    assert 0 < len(seqs) < 200 and sorted(seqs) == sorted(r.seq for i in some.collect() for r in store._read(some.where(F.col("sst_id") == i.sst_id)).collect())
    assert len(store._read(some).exceptAll(store.log()).take(1)) == 0
    # the oldest file and its overlaps go into level 1; a folder goes when no file in it is live
    store.compact()
    store.vacuum()
    assert {r.key: r.value for r in reads.live(Store(spark, store.path, store.config).log()).collect()} == want
    store.compact()
    store.vacuum()
    assert [n for n in folders.names(spark, f"{store.path}/data/edit=1") if n[0] == "s"] == []
    assert {r.key: r.value for r in reads.live(Store(spark, store.path, store.config).log()).collect()} == want


def test_closure_of_a_long_chain_takes_few_jobs(spark):
    files = [(i, 0, f"k{500 - i:03}", f"k{501 - i:03}") for i in range(60)] + [(60, 0, "a", "b"), (61, 1, "k470", "k480")]
    spark.sparkContext.setJobGroup("closure", "")
    got = compaction.overlap_closure(spark.createDataFrame(files, FILES).coalesce(1))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("closure"))
    spark.sparkContext.setJobGroup("", "")
    assert sorted(r.sst_id for r in got.collect()) == list(range(60)) and jobs < 20


def test_files_are_looked_up_by_range(spark):
    keys = [f"k{i:03}" for i in range(0, 600, 2)]
    files = [(i, i % 2, f"k{i * 7:03}", f"k{i * 7 + i % 5 * 30:03}") for i in range(80)] + [(99, 1, "", "z"), (100, 0, "k0", "k0")]
    got = tables.candidates(spark.createDataFrame([(k,) for k in keys + keys[:9]] + [(None,)], "key string"), spark.createDataFrame(files, FILES))
    assert sorted(map(tuple, got.collect())) == sorted((k, f[0], f[1]) for k in keys for f in files if f[2] <= k <= f[3])
    # keys and files meet by an equality; a range alone compares each key with each file
    conditions = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line and "smallest_key" in line]
    assert conditions and all("key_range" in line for line in conditions)


def test_windows_do_not_carry_the_text(spark):
    from tidelog.llm import decontam
    docs = spark.createDataFrame([(1, "one two Three four five 6 seven eight nine"), (2, "short"), (3, None)], "doc_id long, text string")
    side = decontam._side(docs, "doc_id", "text", [8])
    assert sorted(r.at for r in side.collect()) == [0, 0, 1, 1] and {r.key for r in side.collect()} == {1}
    # what Spark compiles and what keeps no array in its rows
    line = [x for x in side._jdf.queryExecution().executedPlan().toString().split("\n") if "Generate" in x]
    assert len(line) == 1 and "[key#" in line[0] and "v#" not in line[0]
