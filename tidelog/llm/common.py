"""Chunks of documents and the exchange of hashed keys between them.

A *chunk* is one row that packs a few megabytes of whole documents.  Chunks
are written once as a table bucketed by ``chunk_id`` in the shared scratch
folder, so later passes read a chunk without shuffling its text again.

Each chunk sends its sorted distinct 64-bit keys (with attributes) to hash
buckets (``blocks``, ``reduced``) and gets each bucket's answers back
(``with_answers``).  A key is sent at most once per chunk, however often it
occurs, so a hot key adds one entry per chunk to its bucket and never a row per
occurrence.

Words are named by the 128-bit xxh3 hash of their bytes, in two halves.  Runs of
words are named by mixing those names pair by pair, so equal names of unlike runs
are accidents of a random function, without the collisions that sums of powers
have.  Operators that remove or link on equal names compare both halves.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
#: A document's reference is chunk_id << REF_BITS | its place in the chunk.
REF_BITS = 20
NULL_ID = np.iinfo(np.int64).min
CHUNK_SCHEMA = "chunk_id long, ids binary, lens binary, body binary, rest binary"
BLOCK_SCHEMA = "bucket int, chunk_id long, payload binary"

_seeds = np.random.RandomState(20240229)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD1B54A32D192ED03)
_BASE = np.uint64(0xD1342543DE82EF95)
_BYTE = _seeds.randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


# -- scratch ---------------------------------------------------------------

def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the application ends.

    Where that is unset a local session makes one; on a cluster it is an error,
    as executors would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tidelog-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame) -> DataFrame:
    """Write a DataFrame to scratch and read it back: lineage ends here."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def written_by(df: DataFrame, key: str) -> DataFrame:
    """As ``written``, bucketed by ``key``: joins on it need no shuffle of this side.

    Buckets need a table; the files are its only lasting part, so the catalogue
    forgets the name as soon as the table is read.
    """
    spark = df.sparkSession
    name = f"tidelog_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("compression", "zstd").option("path", scratch(spark))
       .bucketBy(partitions(spark), key).saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


# -- chunks ----------------------------------------------------------------

def cut(batches, chunk_bytes: int = CHUNK_BYTES):
    """Batches of (id, text, more columns) as pieces: ids and which are null, lengths, joined texts, the other columns."""
    for batch in batches:
        ids, null = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False), np.array(batch.column(0).is_null())
        bodies = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        lens = np.diff(np.frombuffer(bodies.buffers()[1], np.int64, len(bodies) + 1, bodies.offset * 8)) if len(ids) else ids
        ends = np.cumsum(lens)
        carried = pa.Table.from_batches([batch]).select(list(range(2, batch.num_columns)))
        at = 0
        while at < len(ids):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + chunk_bytes, "right")))
            to = min(to, at + (1 << REF_BITS))
            yield (ids[at:to].tobytes() + null[at:to].tobytes(), lens[at:to].tobytes(),
                   b"\n".join(bodies[at:to].to_pylist()) + b"\n", carried.slice(at, to - at))
            at = to


def pieces(batches, chunk_bytes: int = CHUNK_BYTES):
    """Chunks of a task's own batches, for operators that need no exchange."""
    for ids, lens, body, carried in cut(batches, chunk_bytes):
        yield Chunk(0, ids, lens, body, b""), carried


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            chunk_bytes: int = CHUNK_BYTES, carry: tuple = ()) -> DataFrame:
    """Pack documents into chunks of about ``chunk_bytes``; a null text is empty.

    Columns named in ``carry`` travel along unread and come back by ``Chunk.rest``.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, (ids, lens, body, carried) in enumerate(cut(batches, chunk_bytes)):
            rest = pa.BufferOutputStream()
            with pa.ipc.new_stream(rest, carried.schema) as out:
                out.write_table(carried)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << REF_BITS) | k]), pa.array([ids]), pa.array([lens]),
                 pa.array([body], pa.binary()), pa.array([rest.getvalue().to_pybytes()], pa.binary())],
                names=["chunk_id", "ids", "lens", "body", "rest"])

    narrow = docs.select(docs[id_col].cast("long").alias("a"), docs[text_col].cast("string").alias("b"),
                         *(docs[c].alias(f"c{i}") for i, c in enumerate(carry)))
    return written_by(narrow.mapInArrow(run, CHUNK_SCHEMA), "chunk_id")


class Chunk:
    """One chunk inside a task: ``data`` holds the texts, a newline after each."""

    def __init__(self, chunk_id, ids, lens, body, rest):
        self._rest = rest
        self.id = chunk_id
        self.lens = np.frombuffer(lens, np.int64)
        #: Null ids sort first: they stand as the least number, and ``null`` tells them from it.
        self.ids = np.frombuffer(ids, np.int64, len(self.lens))
        self.null = np.frombuffer(ids, bool, len(self.lens), 8 * len(self.lens))
        self.body = body
        self.data = np.frombuffer(body, np.uint8)
        self.ends = np.cumsum(self.lens + 1) - 1
        self.starts = self.ends - self.lens

    @classmethod
    def of(cls, texts: list[bytes]) -> "Chunk":
        """A chunk of texts without ids."""
        n = len(texts)
        return cls(0, bytes(9 * n), np.array([len(t) for t in texts], np.int64).tobytes(), b"".join(t + b"\n" for t in texts), b"")

    def rest(self) -> pa.Table:
        """The carried columns, a row for each document."""
        return pa.ipc.open_stream(self._rest).read_all()

    def text(self, i: int) -> bytes:
        return self.body[self.starts[i]:self.ends[i]]

    def words(self, lower: bool = False) -> "Words":
        """Words between ASCII white space."""
        space = _SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        letters = self.data[~space]
        if lower:
            letters = _FOLD[letters]
        ends = np.concatenate([[0], np.cumsum(end - start)])
        column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        distinct, (_, cuts, raw) = column.dictionary, column.dictionary.buffers()
        cuts, raw = np.frombuffer(cuts, np.int64, len(distinct) + 1).tolist(), (raw or b"") and raw.to_pybytes()
        names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip(cuts, cuts[1:])]), np.uint64).reshape(-1, 2)
        which = column.indices.to_numpy()
        return Words(names[which, 0], names[which, 1], start, end, np.searchsorted(start, np.append(self.starts, len(self.data))))

    def ids_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null)

    def remainders(self, modulus: int) -> np.ndarray:
        """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
        return np.array([zlib.crc32(b"" if null else str(x).encode()) % modulus
                         for x, null in zip(self.ids.tolist(), self.null.tolist())], np.int64)


class Words(NamedTuple):
    """Words of a chunk: both halves of their names, bounds, and each document's first word (and the total)."""

    name: np.ndarray
    other: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def chunks_of(batches):
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(5))):
            yield Chunk(*(x.as_py() for x in row))
            pa.default_memory_pool().release_unused()


# -- hashing ---------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_tables: dict = {}


def _table(kind: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _tables[kind] = have = np.multiply.accumulate(have)
    return have


def powers(n: int) -> np.ndarray:
    return _table("up", int(_BASE), n)


def inverse_powers(n: int) -> np.ndarray:
    return _table("down", pow(int(_BASE), -1, 2**64), n)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Names of all runs of ``width`` named values (by doubling, so O(log width) passes)."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    out, have, block, size = None, 0, h, 1
    while True:
        if width & size:
            if out is None:
                out, have = block, size
            else:
                n = len(h) - have - size + 1
                out = mix(out[:n] * _ODD + block[have:have + n] * _TURN)
                have += size
        if have == width:
            return mix(out + _ODD)
        block = mix(block[:len(block) - size] * _ODD + block[size:] * _TURN)
        size *= 2


# -- packing ---------------------------------------------------------------

_KINDS = [np.dtype(x) for x in ("u1", "i1", "u2", "i2", "u4", "i4", "u8", "i8", "f4", "f8")]
_CODE = {x: i for i, x in enumerate(_KINDS)}


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes: equal high bytes of neighbours compress away.

    Before them stand their number, types and lengths, in few bytes, as a block
    may hold a single key.
    """
    parts = [bytes([len(arrays), *(_CODE[a.dtype] for a in arrays)]), np.array([len(a) for a in arrays], np.uint32).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return b"".join(parts)


def unpack(payload: bytes) -> list[np.ndarray]:
    n = payload[0]
    kinds = [_KINDS[c] for c in payload[1:1 + n]]
    out, at = [], 1 + 5 * n
    for kind, size in zip(kinds, np.frombuffer(payload, np.uint32, n, 1 + n).tolist()):
        planes = np.frombuffer(payload, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def blocks(chunk_id: int, n_buckets: int, keys: np.ndarray, *columns: np.ndarray):
    """Split ascending keys by bucket; one record batch of the blocks that are not empty."""
    edges = (np.arange(n_buckets + 1, dtype=object) * 2**64 // n_buckets)[1:-1].astype(np.uint64)
    cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    full = np.flatnonzero(np.diff(cut))
    rows = [pack(*(c[cut[b]:cut[b + 1]] for c in (keys, *columns))) for b in full]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array(np.full(len(full), chunk_id, np.int64)), pa.array(rows, pa.binary())],
        names=["bucket", "chunk_id", "payload"])


def n_buckets(spark: SparkSession, n_chunks: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(4 * partitions(spark), n_chunks * chunk_bytes // BUCKET_BYTES)


def reduced(sent: DataFrame, combine) -> DataFrame:
    """Per bucket: ``combine(keys, owner, columns) -> [(owners' answers)]``.

    ``owner`` numbers the blocks; the answer is a list of arrays as long as
    ``keys``, handed back per block in the order in which its keys were sent.
    ``combine`` may return a second value: a bytes row kept under chunk -1.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        chunk_ids = table.column("chunk_id").to_pylist()
        order = sorted(range(len(chunk_ids)), key=chunk_ids.__getitem__)
        payloads = table.column("payload")
        got = [unpack(payloads[i].as_py()) for i in order]
        sizes = [len(x[0]) for x in got]
        columns = [np.concatenate(x) for x in zip(*got)]
        owner = np.repeat(np.arange(len(got)), sizes)
        answers, extra = combine(columns[0], owner, columns[1:])
        cut = np.cumsum([0, *sizes])
        ids = [chunk_ids[i] for i in order]
        rows = [pack(*(a[cut[i]:cut[i + 1]] for a in answers)) for i in range(len(got))] if answers else []
        if not answers:
            ids = []
        if extra is not None:
            ids, rows = [*ids, -1], [*rows, extra]
        return pa.table({"bucket": pa.array([bucket] * len(ids), pa.int32()), "chunk_id": pa.array(ids, pa.int64()),
                         "payload": pa.array(rows, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, BLOCK_SCHEMA)


def gathered(table: pa.Table) -> list[np.ndarray]:
    """A chunk's answers, joined in bucket order: aligned with the keys it sent."""
    if not table.num_rows:
        return []
    order = np.argsort(table.column("bucket").to_numpy())
    payloads = table.column("payload")
    return [np.concatenate(x) for x in zip(*(unpack(payloads[int(i)].as_py()) for i in order))]


def with_answers(chunks: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """``run(chunk, answers) -> pa.Table`` for each chunk and the answers sent back to it."""
    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for batch in left.to_batches():
            for chunk in chunks_of([batch]):
                tables.append(run(chunk, right))
        return pa.concat_tables(tables)

    return (chunks.groupBy("chunk_id").cogroup(answers.where("chunk_id >= 0").groupBy("chunk_id"))
            .applyInArrow(both, schema))


def grouped(keys: np.ndarray):
    """Stable order by key, group starts in it, and each sorted row's group number."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    group = np.zeros(len(k), np.int64)
    group[first[1:]] = 1
    return order, first, np.cumsum(group)
