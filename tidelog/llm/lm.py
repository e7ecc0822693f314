"""Deleted-interpolation bigram scoring of whole documents.

P(w | v) = a[b]·c(v,w)/c(v) + u[b]·c(w)/N + z[b]/(V+1), where the weights
a, u, z of bucket b (the power of two that the context count c(v) falls in)
sum to one.  They are learned by expectation-maximisation: one fold of the
training documents is deleted from the counts, and its tokens are explained by
the counts of the others.  EM needs of a token only its bucket and its two
maximum-likelihood estimates; these are counted over all deleted documents on a
grid of eighths of powers of two, a table whose size does not grow with the
corpus, and EM runs on that table.  Scores use exact counts of all training documents.

Counts are sums over all training documents, exchanged by hashed key: every
chunk sends each of its distinct unigrams and bigrams once and gets back the
totals.  Words are compared by 64-bit hash.

Defined results: a null or empty text is one end token; a null doc_id counts
as the empty text for its fold; repeated rows count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)
_GRID = 8
_NONE = 4095
SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


class _Tokens:
    """A chunk's tokens and its distinct keys; unigram keys are odd, bigram keys even."""

    def __init__(self, chunk: C.Chunk):
        words = chunk.words(lower=True)
        h, first = words.name, words.first
        n_docs = len(chunk.ids)
        self.length = np.diff(first) + 1
        self.ends = np.cumsum(self.length) - 1
        self.doc = np.repeat(np.arange(n_docs), self.length)
        token = np.empty(len(h) + n_docs, np.uint64)
        word = np.ones(len(token), bool)
        word[self.ends] = False
        token[word], token[~word] = h, _END
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.ends - self.length + 1] = _START
        odd, even = np.uint64(1), np.uint64(2**64 - 2)
        uni, self.token = np.unique(np.append(token, _START) | odd, return_inverse=True)
        self.start_at = self.token[-1]
        self.token = self.token[:-1]
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.ends - self.length + 1] = self.start_at
        bi, self.pair = np.unique(C.mix(before * np.uint64(0xF1357AEA2E62A9C5) + token) & even, return_inverse=True)
        self.keys = np.concatenate([uni, bi])
        self.order = np.argsort(self.keys, kind="stable")
        self.n_uni = len(uni)

    def counts(self, docs: np.ndarray) -> np.ndarray:
        """Of each key, over the documents marked."""
        here = docs[self.doc]
        uni = np.bincount(self.token[here], minlength=self.n_uni)
        uni[self.start_at] = docs.sum()
        return np.concatenate([uni, np.bincount(self.pair[here], minlength=len(self.keys) - self.n_uni)])

    def totals(self, answers: pa.Table):
        out = []
        for column in C.gathered(answers):
            back = np.empty(len(column), np.int64)
            back[self.order] = column
            out.append((back[:self.n_uni], back[self.n_uni:]))
        return out


def _summed(keys, owner, columns):
    order, first, group = C.grouped(keys)
    answers, sums = [], []
    for c in columns:
        total = np.add.reduceat(c[order].astype(np.int64), first)
        back = np.empty(len(keys), np.int64)
        back[order] = total[group]
        answers.append(back.astype(np.uint32) if total.max(initial=0) < 2**32 else back)
        sums.append(total)
    kept = keys[order][first]
    uni = (kept & np.uint64(1)).astype(bool) & (kept != (_START | np.uint64(1)))
    stats = [x for s in sums for x in (s[uni].sum(), (s[uni] > 0).sum())]
    return answers, C.pack(np.array(stats, np.int64))


def _grid(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        q = np.round(-_GRID * np.log2(p))
    return np.where(p > 0, np.minimum(q, _NONE - 1), _NONE).astype(np.int64)


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.frexp(c.astype(float))[1]


def weights(cells, n_distinct: int, rounds: int = 60) -> np.ndarray:
    """EM over (bucket, bigram cell, unigram cell, count): weights[bucket] = (bigram, unigram, uniform)."""
    out = np.tile([0.4, 0.4, 0.2], (64, 1))
    if not len(cells):
        return out
    b, p2, p1, n = np.array(cells, np.int64).T
    p = np.stack([np.where(p2 < _NONE, 2.0 ** (-p2 / _GRID), 0), np.where(p1 < _NONE, 2.0 ** (-p1 / _GRID), 0),
                  np.full(len(n), 1 / (n_distinct + 1))], 1)
    prior = 1.0
    for _ in range(rounds):
        share = out[b] * p
        share *= (n / share.sum(1))[:, None]
        got = np.stack([np.bincount(b, share[:, i], 64) for i in range(3)], 1)
        pooled = got.sum(0) / got.sum()
        got += prior * pooled
        out = got / got.sum(1, keepdims=True)
    out[0, 0] = 0.0  # a context that was never seen has no bigram estimate
    return out / out.sum(1, keepdims=True)


def score(docs: DataFrame, folds: int = 10, held_out_fold: int = 0, em_fold: int = 9, add: float = 0.1,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all documents, learning from those outside ``held_out_fold``.

    The columns are those of ``SCHEMA``: base_score is the unigram score with
    add-``add`` smoothing, score the model's; both are log10 of the text's probability.
    """
    spark = docs.sparkSession
    chunks = C.chunked(docs, id_col, text_col)
    nb = C.n_buckets(spark, chunks.select("chunk_id").count())

    def send(batches):
        for chunk in C.chunks_of(batches):
            t, fold = _Tokens(chunk), chunk.remainders(folds)
            both = [t.counts(fold != held_out_fold), t.counts(fold == em_fold)]
            yield C.blocks(chunk.id, nb, t.keys[t.order], *(c[t.order].astype(np.uint32) for c in both))

    totals = C.written(C.reduced(chunks.mapInArrow(send, C.BLOCK_SCHEMA), _summed))
    sums = totals.where("chunk_id = -1").select("payload")

    def add_up(batches):
        for batch in batches:
            got = [C.unpack(x.as_py())[0] for x in batch.column(0)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.array(got).T], names=list("abcd"))

    n, v, n_em, _ = (x or 0 for x in sums.mapInArrow(add_up, "a long, b long, c long, d long")
                     .agg(*(F.sum(c) for c in "abcd")).first())

    def cells(chunk: C.Chunk, answers: pa.Table) -> pa.Table:
        t, fold = _Tokens(chunk), chunk.remainders(folds)
        here = (fold == em_fold)[t.doc]
        (u_all, b_all), (u_em, b_em) = t.totals(answers)
        u, b = u_all - u_em, b_all - b_em
        context, pair, token = u[t.context[here]], b[t.pair[here]], u[t.token[here]]
        key = (_bucket(context) << 24) | (_grid(pair / np.maximum(context, 1)) << 12) | _grid(token / max(n - n_em, 1))
        key, times = np.unique(key, return_counts=True)
        return pa.table([pa.array(key >> 24), pa.array(key >> 12 & 4095), pa.array(key & 4095), pa.array(times)],
                        names=["b", "p2", "p1", "n"])

    grid = (C.with_answers(chunks, totals, cells, "b long, p2 long, p1 long, n long")
            .groupBy("b", "p2", "p1").agg(F.sum("n").alias("n")))
    mix = weights([tuple(x) for x in grid.collect()], v)

    def final(chunk: C.Chunk, answers: pa.Table) -> pa.Table:
        t, fold = _Tokens(chunk), chunk.remainders(folds)
        (u, b), _ = t.totals(answers)
        token, context = u[t.token], u[t.context]
        w = mix[_bucket(context)]
        p = (w[:, 0] * (b[t.pair] / np.maximum(context, 1)) + w[:, 1] * (token / max(n, 1)) + w[:, 2] / (v + 1))
        base = np.log10((token + add) / (n + add * (v + 1)))
        first = t.ends - t.length + 1
        total = lambda x: np.add.reduceat(x, first)
        return pa.table([chunk.ids_column(), pa.array(fold == held_out_fold), pa.array(t.length, pa.int64()),
                         pa.array(total((token > 0).astype(np.int64))), pa.array(np.full(len(fold), n, np.int64)),
                         pa.array(total(base)), pa.array(total(np.log10(p)))],
                        names=[x.split()[0] for x in SCHEMA.split(", ")])

    return C.with_answers(chunks, totals, final, SCHEMA)
