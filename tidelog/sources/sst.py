"""The binary sorted-file format: written by column expressions, read file by file.

File: blocks, an index, a footer of five 64-bit numbers (blocks, index offset,
index length, least and greatest sequence number).  Block: entries, an (offset,
size) record for each, and a trailer (entries, where the records start).  Index
record: smallest key, largest key (each after its 32-bit length), offset, length.
All numbers are little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.entries import encoded_entry, little_endian
from tidelog.model import LOG, PUT

_FOOTER = struct.Struct("<5Q")
_RECORD = struct.Struct("<2Q")


def joined(parts: Column) -> Column:
    """An array of byte strings as one."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def encoded_blocks(entries: DataFrame) -> DataFrame:
    """(sst_id, block_id, smallest_key, largest_key, min_seq, max_seq, body) from (sst_id, block_id, key, value, op, seq).

    A block holds some kilobytes, so gathering its entries is bounded.
    """
    own = entries.select("sst_id", "block_id", "key", "seq", encoded_entry().alias("e"))
    packed = own.groupBy("sst_id", "block_id").agg(
        F.sort_array(F.collect_list(F.struct("key", (-F.col("seq")).alias("age"), "e"))).alias("x"),
        F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"),
        F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
    size = F.transform("x.e", lambda e: F.octet_length(e).cast("long"))
    offset = F.transform("size", lambda _, i: F.aggregate(F.slice("size", 1, i), F.lit(0).cast("long"), lambda a, s: a + s))
    records = F.transform(F.arrays_zip("offset", "size"), lambda r: F.concat(little_endian(r.offset, 8), little_endian(r["size"], 8)))
    total = F.aggregate("size", F.lit(0).cast("long"), lambda a, s: a + s)
    return packed.withColumn("size", size).withColumn("offset", offset).select(
        "sst_id", "block_id", "smallest_key", "largest_key", "min_seq", "max_seq",
        F.concat(joined(F.col("x.e")), joined(records), little_endian(F.size("size"), 8), little_endian(total, 8)).alias("body"))


def encoded_files(blocks: DataFrame) -> DataFrame:
    """(sst_id, body): a file's blocks, index and footer.  A file is bounded by the memtable it comes from."""
    all_of = F.sort_array(F.collect_list(F.struct("block_id", "smallest_key", "largest_key", "body", "min_seq", "max_seq"))).alias("b")
    files = blocks.groupBy("sst_id").agg(all_of).withColumn("n", F.transform("b.body", lambda x: F.octet_length(x).cast("long")))
    files = files.withColumn("at", F.transform("n", lambda _, i: F.aggregate(F.slice("n", 1, i), F.lit(0).cast("long"), lambda a, s: a + s)))
    key = lambda k: F.concat(little_endian(F.octet_length(k), 4), k.cast("binary"))
    index = F.transform(F.arrays_zip("b", "at", "n"), lambda r: F.concat(
        key(r.b.smallest_key), key(r.b.largest_key), little_endian(r["at"], 8), little_endian(r.n, 8)))
    files = files.withColumn("index", joined(index)).withColumn("total", F.aggregate("n", F.lit(0).cast("long"), lambda a, s: a + s))
    footer = F.concat(little_endian(F.size("n"), 8), little_endian("total", 8), little_endian(F.octet_length("index"), 8),
                      little_endian(F.array_min("b.min_seq"), 8), little_endian(F.array_max("b.max_seq"), 8))
    return files.select("sst_id", F.concat(joined(F.col("b.body")), F.col("index"), footer).alias("body"))


def entries_of(body: bytes) -> Iterator[tuple[str, str | None, int, int]]:
    """(key, value, op, seq) of a file, in its order; an empty put has an empty value."""
    n_blocks, index_at, _, _, _ = _FOOTER.unpack(body[-_FOOTER.size:])
    at = index_at
    for _ in range(n_blocks):
        for _ in range(2):
            at += 4 + struct.unpack_from("<I", body, at)[0]
        start, length = _RECORD.unpack_from(body, at)
        at += _RECORD.size
        count, records = _RECORD.unpack_from(body, start + length - _RECORD.size)
        for k in range(count):
            offset, size = _RECORD.unpack_from(body, start + records + k * _RECORD.size)
            entry = body[start + offset:start + offset + size]
            op, n = struct.unpack_from("<BI", entry)
            key, value, rest = entry[5:5 + n], None, 5 + n
            if op == PUT:
                m = struct.unpack_from("<I", entry, rest)[0]
                value, rest = entry[rest + 4:rest + 4 + m].decode(), rest + 4 + m
            yield key.decode(), value, op, struct.unpack_from("<Q", entry, rest)[0]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log in the ``.sst`` files of a folder."""
    def run(batches):
        for batch in batches:
            for body in batch.column(0):
                rows = list(entries_of(body.as_py()))
                key, value, op, seq = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(value, pa.string()), pa.array(op, pa.int32()),
                                                  pa.array(seq, pa.int64())], names=["key", "value", "op", "seq"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path)
    return files.select("content").mapInArrow(run, LOG)


def write(files: DataFrame, path: str) -> None:
    """Write (sst_id, body) rows as ``<sst_id>.sst`` in a folder that all executors share."""
    def run(batches):
        import os

        target = path.removeprefix("file:")
        os.makedirs(target, exist_ok=True)
        for batch in batches:
            for sst_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = os.path.join(target, f".{sst_id}.part-{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(body)
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(part, os.path.join(target, f"{sst_id}.sst"))  # a rerun task replaces its file
                yield pa.RecordBatch.from_arrays([pa.array([sst_id])], names=["sst_id"])

    files.select("sst_id", "body").mapInArrow(run, "sst_id long").count()
