import struct

import pytest
from pyspark.sql import functions as F

from tidelog.functions.entries import encoded_entry, entry_bytes, normal_op, payload_bytes
from tidelog.model import Config, load_config
from tidelog.operators.cuts import greedy_within
from tidelog.sources import manifest, sst

LOG = "key string, value string, op int, seq long"


def entry(key, value, op, seq):
    body = b"" if op else struct.pack("<I", len(value)) + value
    return struct.pack("<BI", op, len(key)) + key + body + struct.pack("<Q", seq)


def test_entry_bytes_and_layout(spark):
    rows = [("apple", "value1", 0, 12345), ("apply", "success", 0, 9876), ("colossus", "thunder", 0, 2**32 - 1), ("", "", 0, 10), ("gone", None, 1, 7)]
    got = spark.createDataFrame(rows, LOG).select("key", encoded_entry().alias("e"), entry_bytes().alias("n"), payload_bytes().alias("p")).collect()
    for (key, value, op, seq), r in zip(rows, got):
        want = entry(key.encode(), (value or "").encode(), op, seq)
        assert bytes(r.e) == want and r.n == len(want) and r.p == len(key) + len(value or "")
    assert got[3].n == 17


def test_empty_put_is_a_delete(spark):
    rows = spark.createDataFrame([("a", "", 0), ("b", None, 0), ("c", "x", 0), ("d", "x", 1)], "key string, value string, op int")
    assert [r.o for r in rows.select(normal_op("value", "op").alias("o")).collect()] == [1, 1, 0, 1]


def test_block_bytes(spark):
    rows = [("apple", "value1", 0, 12345), ("apply", "success", 0, 9876), ("colossus", "thunder", 0, 2**32 - 1)]
    df = spark.createDataFrame(rows, LOG).withColumn("sst_id", F.lit(1).cast("long")).withColumn("block_id", F.lit(0).cast("long"))
    parts = [entry(k.encode(), v.encode(), o, s) for k, v, o, s in rows]
    at, records = 0, b""
    for p in parts:
        records += struct.pack("<2Q", at, len(p))
        at += len(p)
    assert bytes(sst.encoded_blocks(df).first().body) == b"".join(parts) + records + struct.pack("<2Q", 3, at)


def test_files_round_trip(spark, tmp_path):
    rows = [(f"key{i % 40:03d}", None if i % 7 == 0 else f"wört{i}", int(i % 7 == 0), i) for i in range(1, 300)] + [("", "", 0, 300)]
    df = spark.createDataFrame(rows, LOG).withColumn("sst_id", F.col("seq") % 3).withColumn("n", entry_bytes() + 16)
    blocks = greedy_within(df, "sst_id", ["key", "-seq"], "n", 256, "block_id")
    sst.write(sst.encoded_files(sst.encoded_blocks(blocks)), str(tmp_path / "files"))
    got = sst.read(spark, str(tmp_path / "files")).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, rows))


def test_edit_json_and_documents(spark):
    files = [{"id": 2, "level": 1, "size": 5, "smallest_key": "a", "largest_key": "b"}, {"id": 1, "level": 0, "size": 5, "smallest_key": "a", "largest_key": "b"}]
    one = manifest.edit_json(3, 9, files, [{"id": 7, "level": 0}])
    assert one == ('{"next_table_id":3,"sequence_number":9,"new_files":[{"id":1,"level":0,"size":5,"smallest_key":"a","largest_key":"b"},'
                   '{"id":2,"level":1,"size":5,"smallest_key":"a","largest_key":"b"}],"delete_files":[{"id":7,"level":0}]}')
    two = manifest.edit_json(4, 10)
    assert two == '{"next_table_id":4,"sequence_number":10}'
    assert manifest.split_documents(one + two + "\n " + one) == [one, two, one] and manifest.split_documents("") == []
    edits = manifest.literal_edits(spark, [one, two])
    assert sorted(r.sst_id for r in manifest.replay(edits).collect()) == [1, 2]
    assert tuple(manifest.counters(edits).first()) == (4, 10)


GOOD = """
[lsm]
LSM_PER_MEM_SIZE_LIMIT = 33554432
MAX_IMMUTABLE_MEMTABLES_IN_MEMORY = 4
SST_BLOCK_SIZE = 4096
LSM_SST_NUM_LEVELS = 7
LVL0_COMPACTION_TRIGGER = 6
TOTAL_BG_THREADS = 12
[cache]
TOTAL_TABLES_CACHE = 1000
TOTAL_BLOCKS_EACH_CACHE = 20000
TOTAL_BLOCKS_CACHE = 5
"""


def test_config():
    assert load_config(GOOD) == Config()
    for old, new in (("= 33554432", "= 1024"), ("= 7\n", "= 8\n"), ("[cache]", "[other]"), ("= 1000", "= -1"), ("= 4\n", '= "4"\n')):
        with pytest.raises(ValueError):
            load_config(GOOD.replace(old, new, 1))
