"""Exact removal of repeated word windows, found through difference-cover anchors.

A window is ``width`` consecutive words of one document.  With a difference
cover D modulo p, any two windows of equal words at starts i and j have an
offset d < p with both (i + d) mod p and (j + d) mod p in D.  So only the
positions in D are hashed (4 of 13), as anchors of ``width - p + 1`` words, and
equal windows share an aligned anchor.  Anchors found twice are then extended:
the whole windows around them are named by 128 bits and compared.

The first pass sends each chunk's distinct anchors, the second only windows
that hold a repeated anchor.  A word of a window goes if the same words start
earlier: smaller doc_id, or same document and earlier start.

Defined results: a null or empty text has no words; a null doc_id sorts first
and comes back null; rows that share a doc_id are ordered by a hash of their
text, and of fully equal rows one stays.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C

#: Perfect difference covers by modulus.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}


def _period(width: int) -> int:
    return max(p for p in COVERS if p == 1 or width - p + 1 >= 8)


class _Windows:
    """A chunk's words, anchors and candidate windows."""

    def __init__(self, chunk: C.Chunk, width: int):
        self.chunk, self.width, self.period = chunk, width, _period(width)
        words = chunk.words()
        self.h, self.other, self.first = words.name, words.other, words.first
        n = len(self.h)
        self.length = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.length)), self.length)
        self.at = np.arange(n) - self.first[self.doc]
        size = width - self.period + 1
        all_anchors = C.windows(self.h, size)
        here = np.isin(self.at % self.period, COVERS[self.period])
        here &= self.at + size <= self.length[self.doc]
        self.places = np.flatnonzero(here)
        self.anchors, self.which, self.times = np.unique(
            all_anchors[self.places], return_inverse=True, return_counts=True)

    def candidates(self, repeated: np.ndarray):
        """Starts of windows that hold a repeated anchor, and the distinct windows by both halves of their names."""
        n = len(self.h)
        mark = np.zeros(n + self.period + 1, np.int32)
        mark[self.places[repeated[self.which].astype(bool)]] = 1
        before = np.concatenate([[0], np.cumsum(mark)])
        start = np.arange(n)
        near = before[start + self.period] > before[start]
        near &= self.at + self.width <= self.length[self.doc]
        start = np.flatnonzero(near)
        rank = self.ranks()
        order = np.argsort(rank[self.doc[start]], kind="stable")
        self.start = start[order]
        key, second = (C.windows(x, self.width)[self.start] for x in (self.h, self.other))
        order = np.lexsort((second, key))
        k, s = key[order], second[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(k) else np.zeros(0, bool)
        self.keys, self.second, self.earliest = k[new], s[new], order[new]

    def ranks(self) -> np.ndarray:
        self.salt = np.array([xxhash.xxh32_intdigest(self.chunk.text(i)) for i in range(len(self.length))], np.uint32)
        rank = np.empty(len(self.length), np.int64)
        rank[np.lexsort((self.salt, self.chunk.ids))] = np.arange(len(rank))
        return rank

    def removed(self, mine: np.ndarray) -> np.ndarray:
        """Per word: is it covered by a window that starts earlier as well?"""
        keep = np.zeros(len(self.start), bool)
        keep[self.earliest[mine.astype(bool)]] = True
        cover = np.zeros(len(self.h) + 1, np.int64)
        gone = self.start[~keep]
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + self.width, -1)
        return np.cumsum(cover[:-1]) > 0


def _repeated(keys, owner, columns):
    order, first, group = C.grouped(keys)
    times = np.add.reduceat(columns[0][order].astype(np.int64), first) if len(first) else first
    out = np.empty(len(keys), np.uint8)
    out[order] = (times > 1)[group]
    return [out], None


def _earliest(keys, owner, columns):
    second, doc, salt, start = columns
    order = np.lexsort((owner, start, salt, doc, second, keys))
    k, s = keys[order], second[order]
    out = np.zeros(len(keys), np.uint8)
    if len(k):
        out[order[np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])]] = 1
    return [out], None


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   carry: tuple = (), layout: bool = False) -> DataFrame:
    """Per document: doc_id, kept_text, n_words, n_removed and the carried columns.

    ``kept_text`` joins the kept words by one space; ``n_removed`` is 0 for a
    document that repeats nothing earlier.  With ``layout`` the text of such a
    document is returned as it is.
    """
    spark = docs.sparkSession
    chunks = C.chunked(docs, id_col, text_col, carry=carry)
    nb = C.n_buckets(spark, chunks.select("chunk_id").count())

    def anchors(batches):
        for chunk in C.chunks_of(batches):
            w = _Windows(chunk, width)
            yield C.blocks(chunk.id, nb, w.anchors, np.minimum(w.times, 2).astype(np.uint8))

    repeated = C.written(C.reduced(chunks.mapInArrow(anchors, C.BLOCK_SCHEMA), _repeated))

    def parts(answers: pa.Table):
        first = np.array(answers.column("bucket")) < nb
        one = C.gathered(answers.filter(pa.array(first)))
        two = C.gathered(answers.filter(pa.array(~first)))
        return (one[0] if one else np.zeros(0, np.uint8)), (two[0] if two else np.zeros(0, np.uint8))

    def extend(chunk: C.Chunk, answers: pa.Table) -> pa.Table:
        w = _Windows(chunk, width)
        w.candidates(parts(answers)[0])
        at = w.start[w.earliest]
        doc = w.doc[at]
        return pa.Table.from_batches([C.blocks(chunk.id, nb, w.keys, w.second, chunk.ids[doc], w.salt[doc], w.at[at].astype(np.uint32))])

    sent = C.with_answers(chunks, repeated, extend, C.BLOCK_SCHEMA)
    owned = C.reduced(sent, _earliest)

    names = ["doc_id", "kept_text", "n_words", "n_removed", *carry]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept_text", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           *(T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry))])

    def cut(chunk: C.Chunk, answers: pa.Table) -> pa.Table:
        w = _Windows(chunk, width)
        one, two = parts(answers)
        w.candidates(one)
        gone = w.removed(two)
        lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
        kept = []
        for i in range(len(w.length)):
            if layout and not lost[i]:
                kept.append(chunk.text(i))
                continue
            words = chunk.text(i).split()
            if lost[i]:
                words = compress(words, (~gone[w.first[i]:w.first[i + 1]]).tolist())
            kept.append(b" ".join(words))
        return pa.Table.from_arrays(
            [chunk.ids_column(), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(w.length, pa.int64()),
             pa.array(lost, pa.int64()), *chunk.rest().columns], names=schema.names)

    second = owned.withColumn("bucket", owned.bucket + nb)
    return C.with_answers(chunks, repeated.unionByName(second), cut, schema).toDF(*names)
