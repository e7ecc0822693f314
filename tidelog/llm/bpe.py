"""Byte-level BPE encoding and decoding with a public vocabulary file.

Texts are split by the vocabulary's pattern; each distinct piece is merged
once per batch and remembered in a bounded cache.  A piece is held as a
contiguous array of parts with the rank of every adjacent pair: the smallest
rank (leftmost on ties) is found by scanning, its boundary is deleted, and the
ranks on both sides are refreshed.  Pieces of like length are scanned side by
side as rows of one array; pieces longer than ``_SHORT`` bytes use a heap.

Defined results: a null or empty text has no tokens and decodes to the empty
text; special tokens inside a text are encoded as such, as the library does.
"""

from __future__ import annotations

import gc
import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, ids array<int>, decoded string"
_SHORT = 48
_CACHE = 200_000
_SLOTS = 1 << 20
_SLICE = 2 << 20
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def _printable() -> dict[str, int]:
    """The printable stand-in of each byte, by the format's rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Vocabulary, merge ranks and special tokens of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, vocab = _printable(), spec["model"]["vocab"]
        self.token = {i: bytes(byte[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: s.encode() for s, i in self.special.items()}
        self.first = np.zeros(256, np.int32)
        for c, b in byte.items():
            self.first[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self._hash(key)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.none = len(pairs)
        self.cache: dict[str, list[int]] = {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _hash(self, keys: np.ndarray) -> None:
        """An open-addressing table of pair -> rank, for lookups of whole arrays."""
        self.keys, self.ranks = np.full(_SLOTS + 64, -1, np.int64), np.full(_SLOTS + 64, len(keys), np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # whoever is first in a free slot stays, the others move on
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            placed = free & (self.keys[at] == keys[left])
            self.ranks[at[placed]] = left[placed]
            left, at = left[~placed], at[~placed] + 1

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 20)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of adjacent parts; ``none`` where they do not merge (or a part is -1)."""
        key = (left.astype(np.int64) << 20) | right
        at = self._slot(key)
        got = self.keys[at]
        missed = np.nonzero((got != key) & (got != -1))
        out = np.where(got == key, self.ranks[at], self.none)
        while len(missed[0]):
            at[missed] += 1
            got = self.keys[at[missed]]
            out[missed] = np.where(got == key[missed], self.ranks[at[missed]], self.none)
            go = (got != key[missed]) & (got != -1)
            missed = tuple(m[go] for m in missed)
        return out

    def _short(self, words: list[bytes]) -> list[list[int]]:
        """Merge words side by side: a row of parts and a row of adjacent ranks each."""
        size = max(map(len, words))
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        parts = np.where(np.arange(size) < lens[:, None], self.first[raw], -1)
        parts = np.concatenate([parts, np.full((n, 1), -1, np.int32)], 1)
        rank = self.rank(parts[:, :-1], parts[:, 1:])
        done: list = [None] * n
        rows = np.arange(n)
        columns = np.arange(size + 1)
        while len(rows):
            at = rank.argmin(1)
            here = np.arange(len(rows))
            best = rank[here, at]
            stop = best == self.none
            if stop.any():
                for r, p in zip(rows[stop].tolist(), parts[stop].tolist()):
                    done[r] = p[:p.index(-1)]
                go = ~stop
                rows, parts, rank, at, best = rows[go], parts[go], rank[go], at[go], best[go]
                here = here[:len(rows)]
                if not len(rows):
                    break
            shift = np.minimum(columns + (columns > at[:, None]), size)
            parts = np.take_along_axis(parts, shift, 1)
            rank = np.take_along_axis(rank, np.minimum(shift[:, :size], size - 1), 1)
            parts[here, at] = self.merged[best]
            parts[:, -1] = -1
            rank[:, -1] = self.rank(parts[:, -2], parts[:, -1])
            rank[here, at] = self.rank(parts[here, at], parts[here, at + 1])
            left = np.maximum(at - 1, 0)
            rank[here, left] = self.rank(parts[here, left], parts[here, left + 1])
        return done

    def _long(self, word: bytes) -> list[int]:
        """Merge one long word with a heap of ranks over linked parts."""
        parts = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.rank(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(ranks) if r < self.none]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            r = int(self.rank(np.array([parts[i]]), np.array([parts[j]]))[0])
            if r < self.none:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [p for p in parts if p >= 0]

    def learn(self, pieces: set) -> None:
        """Encode the pieces that are not in the cache."""
        new = [(w, w.encode()) for w in pieces if w not in self.cache]
        if len(self.cache) + len(new) > _CACHE:
            self.cache = {w: self.cache[w] for w in pieces if w in self.cache}
        new.sort(key=lambda x: len(x[1]))
        short = [x for x in new if len(x[1]) <= _SHORT]
        for at in range(0, len(short), 4096):
            some = short[at:at + 4096]
            self.cache.update(zip((w for w, _ in some), self._short([b for _, b in some])))
        for w, b in new[len(short):]:
            self.cache[w] = self._long(b)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        pieces = []
        for text in texts:
            if self.split is None or "<" not in text:
                pieces.append(_PIECE.findall(text))
            else:
                own = []
                for i, part in enumerate(self.split.split(text)):
                    own += [part] if i % 2 else _PIECE.findall(part)
                pieces.append(own)
        seen = set()
        for own in pieces:
            seen.update(own)
        for s in self.special:
            seen.discard(s)
        self.learn(seen)
        self.cache.update({s: [i] for s, i in self.special.items()})
        get = self.cache.__getitem__
        return [list(chain.from_iterable(map(get, own))) for own in pieces]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, ids, and the text decoded from them.

    ``path`` names a tokenizer file that every executor has.
    """

    def run(batches):
        vocab = vocabulary(path)
        sweeps = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and each sweep would walk the whole cache
        try:
            for batch in batches:
                yield from encoded(vocab, batch)
        finally:
            if sweeps:  # the worker may be used again for something else
                gc.enable()

    def encoded(vocab, batch):
        lens = np.frombuffer(batch.column(1).cast(pa.large_string()).fill_null("").buffers()[1], np.int64,
                             batch.num_rows + 1) if batch.num_rows else np.zeros(1, np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(lens, lens[at] + _SLICE, "right")) - 1)
            some = batch.slice(at, to - at)
            ids = vocab.encode_batch([t or "" for t in some.column(1).to_pylist()])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.ListArray.from_arrays(ends, flat), pa.array([vocab.decode(own) for own in ids], pa.string())],
                names=["doc_id", "ids", "decoded"])
            at = to

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("b")).mapInArrow(run, SCHEMA)
