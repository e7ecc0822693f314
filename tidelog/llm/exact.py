"""Exact removal of repeated byte strings with sharded suffix arrays.

Every string of ``length`` bytes has a minimal anchor: of its substrings of half
that length the one with the least hash, leftmost on ties.  Equal strings have
equal anchors, so an anchor decides the shard in which a string is compared:

1. Each chunk sends its distinct anchors; those found once in all prove their
   strings unique.
2. For a repeated anchor, the strings that share one occurrence of it form one
   piece of text.  Each distinct piece of a chunk (by a 128-bit hash) is sent once
   to the anchor's shard.  The distinct pieces of an anchor are compared by the
   shard's suffix array (:mod:`tidelog.llm.suffix`), built by induced sorting, with
   permuted common prefixes of at least ``length`` bytes.  A piece that was sent
   twice is repeated as a whole; one copy of it enters the array, for the others.
3. An anchor with more than ``hot`` occurrences could make a shard too large (a
   core needs some 150 bytes for a byte of it), so longer ones take its place: the
   bytes that all its strings with neighbouring offsets share.  Twice as many
   occurrences halve the offsets that stay together; beyond eight times ``hot``
   each string is its own anchor, and its 128-bit hash is all that is sent.
4. The answers go back to the chunks, which cut the covered bytes.

Defined results: matches never cross documents; a null text is empty; a text
shorter than ``length`` keeps all; all copies of a repeated string go, in rows of
equal or null doc_id too; what is kept may end within a character, so it is
binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C
from . import suffix

_BLOCK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
#: A core holds some twenty arrays over a chunk's bytes at a time, so chunks are small here.
CHUNK_BYTES = 1 << 20
SHARD_BYTES = 256 << 10
#: How often a hot anchor's offsets are halved before each string is its own anchor.
HALVINGS = 3


class _Strings:
    """A chunk's strings of ``length`` bytes, as runs of starts that share an anchor."""

    def __init__(self, chunk: C.Chunk, length: int):
        self.chunk, self.length = chunk, length
        data, n = chunk.data, len(chunk.data)
        self.total = np.empty(n + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(C._BYTE[data] * C.powers(n)[:n], out=self.total[1:])
        width = max(1, length // 2)
        edge = np.zeros(n + 1, np.int64)
        long = chunk.lens >= length
        edge[chunk.starts[long]] += 1
        edge[chunk.ends[long] - length + 1] -= 1
        valid = np.cumsum(edge[:n]) > 0
        anchor = self.hashes(np.arange(max(0, n - width + 1)), width)
        self.start, self.stop, place = [], [], []
        reach = length - width + 1
        for b in range(0, max(0, n - length + 1), _BLOCK):
            m = min(_BLOCK, n - length + 1 - b)
            low = (anchor[b:b + m + reach - 1] & ~_PLACE) | np.arange(m + reach - 1, dtype=np.uint64)
            size = 1
            while 2 * size <= reach:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            at = b + (np.minimum(low[:m], low[reach - size:reach - size + m]) & _PLACE).astype(np.int64)
            ok = valid[b:b + m]
            new = ok.copy()
            new[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
            last = ok.copy()
            last[:-1] &= ~ok[1:] | (at[1:] != at[:-1])
            first = np.flatnonzero(new)
            self.start.append(b + first)
            self.stop.append(b + np.flatnonzero(last) + 1)
            place.append(at[first])
        empty = np.zeros(0, np.int64)
        self.reach = reach
        self.start, self.stop, self.place = (np.concatenate([empty, *x]) for x in (self.start, self.stop, place))
        # a least hash is small: mixed again, its high bits spread over the buckets
        self.keys, self.which, self.times = np.unique(C.mix(anchor[self.place] + C._ODD), return_inverse=True, return_counts=True)

    def hashes(self, start: np.ndarray, size) -> np.ndarray:
        n = len(self.chunk.data)
        return C.mix((self.total[start + size] - self.total[start]) * C.inverse_powers(n + 1)[start]
                     + np.asarray(size).astype(np.uint64))

    def pieces(self, answer: np.ndarray) -> None:
        """Distinct pieces at repeated anchors: key, hash, how often, and one run of starts that shows it."""
        told = answer[self.which].astype(np.int64) if len(answer) else np.zeros(len(self.which), np.int64)
        run = np.flatnonzero(told)
        level = told[run] - 1
        alone = level > HALVINGS
        start, stop, place = self.start[run], self.stop[run], self.place[run]
        width = np.where(alone, 1, -(-self.reach >> np.minimum(level, HALVINGS)))  # offsets that stay together
        most, least = (place - start) // width, (place - stop + 1) // width
        parts = most - least + 1
        of = np.repeat(np.arange(len(run)), parts)
        q = most[of] - (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
        w, p = width[of], place[of]
        self.run_start = np.maximum(start[of], p - (q + 1) * w + 1)
        self.run_stop = np.minimum(stop[of], p - q * w + 1)
        self.alone = alone[of]
        begin, size = self.run_start.tolist(), (self.run_stop - self.run_start + self.length - 1).tolist()
        body = self.chunk.body
        hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(body[i:i + n]) for i, n in zip(begin, size)]), np.uint64).reshape(-1, 2)
        # what all strings with these offsets share; with all offsets together, the anchor
        core = p - q * w
        last = p - np.minimum((q + 1) * w, self.reach) + 1 + self.length
        key = np.where(level[of] == 0, self.keys[self.which[run]][of], C.mix(self.hashes(core, last - core) + C.mix(q.astype(np.uint64) + w.astype(np.uint64) * C._ODD)))
        key = np.where(self.alone, hashes[:, 0], key)
        order = np.lexsort((hashes[:, 1], hashes[:, 0], key))
        k, h = key[order], hashes[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1]).any(1)]) if len(k) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.run, self.piece = order, np.cumsum(new) - 1
        self.piece_run = order[first]
        self.piece_key, self.piece_hash = k[first], h[first]
        self.piece_times = np.diff(np.append(first, len(k)))

    def covered(self, by_piece: np.ndarray) -> np.ndarray:
        """Per byte: does a repeated string cover it?  ``by_piece``: a flag for each start of each piece, in order."""
        edge = np.zeros(len(self.chunk.data) + 1, np.int64)
        width = (self.run_stop - self.run_start)[self.piece_run]
        begin = (np.cumsum(width) - width)[self.piece]
        width = width[self.piece]
        step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        flag = by_piece[np.repeat(begin, width) + step].astype(bool) if len(step) else np.zeros(0, bool)
        start = (np.repeat(self.run_start[self.run], width) + step)[flag]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.length, -1)
        return np.cumsum(edge[:-1]) > 0


def _anchors(hot: int):
    """0: found once; else one more than how often the anchor's offsets are halved."""
    def combine(keys, owner, columns):
        order, first, group = C.grouped(keys)
        times = np.add.reduceat(columns[0][order].astype(np.int64), first) if len(first) else first
        level = 1 + sum((times > hot << k).astype(np.uint8) for k in range(HALVINGS + 1))
        out = np.empty(len(keys), np.uint8)
        out[order] = np.where(times > 1, level, 0)[group]
        return [out], None

    return combine


def _compare(blocks: list, length: int) -> list[np.ndarray]:
    """Per block (keys, hashes, times, starts, with text or not, text) of pieces: a flag for each start of each piece."""
    key, one, two, times, starts, alone = (np.concatenate([b[i] for b in blocks]) for i in range(6))
    text = b"".join(b[6].tobytes() for b in blocks)
    starts = starts.astype(np.int64)
    size = np.where(alone, 0, starts + length - 1)
    end = np.cumsum(size)
    order = np.lexsort((two, one, key))
    k, s, t = key[order], one[order], two[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    total = np.add.reduceat(times[order].astype(np.int64), first)
    lead = order[first]  # a piece of each group
    k = k[first]
    anchor = np.concatenate([[True], k[1:] != k[:-1]])
    many = (np.bincount(np.cumsum(anchor) - 1)[np.cumsum(anchor) - 1] > 1) & (alone[lead] == 0)
    flags: list = [None] * len(first)
    for g in np.flatnonzero((total > 1) | ~many).tolist():
        flags[g] = np.full(starts[lead[g]], total[g] > 1)
    shard, filled = [], 0
    todo = np.flatnonzero(many)
    for n, g in enumerate(todo.tolist()):
        shard.append(g)
        filled += size[lead[g]]
        if n + 1 == len(todo) or filled >= SHARD_BYTES and k[todo[n + 1]] != k[g]:
            for x, flag in zip(shard, suffix.repeated([text[end[lead[x]] - size[lead[x]]:end[lead[x]]] for x in shard], length)):
                if flags[x] is None:
                    flags[x] = flag
            shard, filled = [], 0
    of = np.empty(len(key), np.int64)
    of[order] = group
    out, at = [], 0
    for b in blocks:
        m = len(b[0])
        out.append(np.concatenate([flags[g] for g in of[at:at + m].tolist()]).astype(np.uint8))
        at += m
    return out


def _compared(sent: DataFrame, length: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        answers = _compare([C.unpack(p.as_py()) for p in table.column("payload")], length)
        return pa.table({"bucket": table.column("bucket"), "chunk_id": table.column("chunk_id"),
                         "payload": pa.array([C.pack(a) for a in answers], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, C.BLOCK_SCHEMA)


def remove_repeats(docs: DataFrame, length: int = 200, hot: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary)."""
    chunks = C.chunked(docs, id_col, text_col, CHUNK_BYTES)
    nb = C.n_buckets(docs.sparkSession, chunks.select("chunk_id").count(), CHUNK_BYTES)

    def anchors(batches):
        for chunk in C.chunks_of(batches):
            s = _Strings(chunk, length)
            yield C.blocks(chunk.id, nb, s.keys, s.times.astype(np.uint32))

    repeated = C.written(C.reduced(chunks.mapInArrow(anchors, C.BLOCK_SCHEMA), _anchors(hot)))

    def parts(answers: pa.Table):
        kind = np.array(answers.column("bucket")) // nb
        got = [C.gathered(answers.filter(pa.array(kind == k))) for k in range(2)]
        return [g[0] if g else np.zeros(0, np.uint8) for g in got]

    def send(chunk: C.Chunk, answers: pa.Table) -> pa.Table:
        s = _Strings(chunk, length)
        s.pieces(parts(answers)[0])
        a, n = s.run_start[s.piece_run], (s.run_stop - s.run_start)[s.piece_run]
        alone = s.alone[s.piece_run]
        size = np.where(alone, 0, n + length - 1)
        edges = (np.arange(nb + 1, dtype=object) * 2**64 // nb)[1:-1].astype(np.uint64)
        cut = np.concatenate([[0], np.searchsorted(s.piece_key, edges), [len(s.piece_key)]])
        full = np.flatnonzero(np.diff(cut))
        rows = []
        for x in full.tolist():
            own = slice(cut[x], cut[x + 1])
            text = b"".join([chunk.body[i:i + m] for i, m in zip(a[own].tolist(), size[own].tolist())])
            rows.append(C.pack(s.piece_key[own], s.piece_hash[own, 0], s.piece_hash[own, 1], np.minimum(s.piece_times[own], 2).astype(np.uint8),
                               n[own].astype(np.uint32), alone[own].astype(np.uint8), np.frombuffer(text, np.uint8)))
        return pa.table([pa.array(full, pa.int32()), pa.array(np.full(len(full), chunk.id)), pa.array(rows, pa.binary())],
                        names=["bucket", "chunk_id", "payload"])

    sent = C.with_answers(chunks, repeated, send, C.BLOCK_SCHEMA)
    compared = _compared(sent, length)
    compared = compared.withColumn("bucket", compared.bucket + nb)

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
                           T.StructField("kept", T.BinaryType())])

    def cut(chunk: C.Chunk, answers: pa.Table) -> pa.Table:
        s = _Strings(chunk, length)
        levels, flags = parts(answers)
        s.pieces(levels)
        gone = s.covered(flags)
        lost = np.concatenate([[0], np.cumsum(gone)])
        runs = np.concatenate([[0], np.cumsum(gone & ~np.concatenate([[False], gone[:-1]]))])
        kept = chunk.data[~gone].tobytes()
        at = np.concatenate([[0], np.cumsum(~gone)])
        texts = [kept[x:y] for x, y in zip(at[chunk.starts].tolist(), at[chunk.ends].tolist())]
        return pa.Table.from_arrays(
            [chunk.ids_column(), pa.array(chunk.lens), pa.array(lost[chunk.ends] - lost[chunk.starts]),
             pa.array(runs[chunk.ends] - runs[chunk.starts]), pa.array(texts, pa.binary())], names=schema.names)

    return C.with_answers(chunks, repeated.unionByName(compared), cut, schema)
