"""Suffix arrays by induced sorting, and permuted common prefixes, on one shard of bytes.

A shard is a few hundred kilobytes, so its arrays stay small.  Suffixes are
classified as smaller or larger than their right neighbour; leftmost-smaller
substrings are sorted by inducing from their first letters and named by comparing
neighbours letter by letter; if names repeat, the string of names is sorted by the
same steps; then the whole array is induced from it in two linear scans.

On bytes a scan treats all entries of a bucket that are known at once, so its steps
are array operations.  A string of names has about as many letters as it has
places, so its buckets are small and its scans go entry by entry.

Common prefixes are computed in text order, and by comparison only where the
letter before differs (the irreducible ones); the others follow by subtraction.
"""

from __future__ import annotations

import numpy as np

_SIGMA = 256


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one to its right; the last letter is the unique smallest."""
    n = len(t)
    apart = np.flatnonzero(t[1:] != t[:-1])
    after = apart[np.minimum(np.searchsorted(apart, np.arange(n - 1)), len(apart) - 1)] if n > 1 else apart
    small = np.ones(n, bool)
    if n > 1:
        small[:-1] = t[after] < t[after + 1]
    return small


class _Induction:
    """One text, its types and buckets; ``sort`` induces all suffixes from sorted leftmost-smaller ones."""

    def __init__(self, t: np.ndarray):
        self.t, self.small = t, classify(t)
        self.count = np.bincount(t, minlength=_SIGMA)
        self.tail = np.cumsum(self.count)
        self.head = self.tail - self.count
        self.letters = np.flatnonzero(self.count).tolist()
        self.leftmost = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1

    def _before(self, j: np.ndarray, small: bool):
        """Predecessors of the wanted type, by letter (stable), with their rank inside it."""
        i = j[j > 0] - 1
        i = i[self.small[i] == small]
        if not len(i):
            return i, i, i, i
        letter = self.t[i]
        order = np.argsort(letter, kind="stable")
        i, letter = i[order], letter[order]
        times = np.bincount(letter, minlength=_SIGMA)
        return i, letter, np.arange(len(i)) - (np.cumsum(times) - times)[letter], times

    def sort(self, given: np.ndarray) -> np.ndarray:
        t, head, tail = self.t, self.head, self.tail
        sa = np.full(len(t), -1, np.int32)
        own = given[np.argsort(t[given], kind="stable")].astype(np.int32)
        cut = np.concatenate([[0], np.cumsum(np.bincount(t[own], minlength=_SIGMA))])
        end = head.copy()

        def larger(j):
            i, letter, rank, times = self._before(j, False)
            if len(i):
                sa[end[letter] + rank] = i
                np.add(end, times, out=end)

        for c in self.letters:
            done = head[c]
            while done < end[c]:
                wave, done = sa[done:end[c]], end[c]
                larger(wave)
            larger(own[cut[c]:cut[c + 1]])
        begin = tail.copy()
        sa[0], begin[t[-1]] = len(t) - 1, 0

        def smaller(j):
            i, letter, rank, times = self._before(j, True)
            if len(i):
                sa[begin[letter] - 1 - rank] = i
                np.subtract(begin, times, out=begin)

        for c in reversed(self.letters):
            done = tail[c]
            while begin[c] < done:
                wave, done = sa[begin[c]:done][::-1], begin[c]
                smaller(wave)
            smaller(sa[head[c]:end[c]][::-1])
        return sa


class _Names:
    """As ``_Induction`` for a string of names, whose last one is the unique smallest: scans entry by entry."""

    def __init__(self, t: np.ndarray):
        self.t, self.small = t, classify(t)
        self.tail = np.cumsum(np.bincount(t))
        self.leftmost = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1

    def sort(self, given: np.ndarray) -> np.ndarray:
        t, small, n = self.t.tolist(), self.small.tolist(), len(self.t)
        sa, end = [-1] * n, self.tail.tolist()
        for i in reversed(given.tolist()):
            end[t[i]] -= 1
            sa[end[t[i]]] = i
        begin = [0, *self.tail[:-1].tolist()]
        for k in range(n):
            i = sa[k] - 1
            if i >= 0 and not small[i]:
                c = t[i]
                sa[begin[c]] = i
                begin[c] += 1
        end = self.tail.tolist()
        for k in range(n - 1, -1, -1):
            i = sa[k] - 1
            if i >= 0 and small[i]:
                c = t[i]
                end[c] -= 1
                sa[end[c]] = i
        sa[0] = n - 1
        return np.array(sa, np.int64)


def _named(t: np.ndarray, p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings at ``p``, given their sorted order: equal ones share a name."""
    stop = np.append(p[1:], len(t) - 1) + 1
    place = np.empty(len(t), np.int32)
    place[p] = np.arange(len(p))
    which = place[first]
    a, size = p[which], (stop - p)[which]
    new = np.ones(len(p), bool)
    same = np.flatnonzero(size[1:] == size[:-1]) + 1  # only these can equal the one before them
    if len(same):
        width = size[same]
        cut = np.cumsum(width) - width
        step = np.arange(int(width.sum()), dtype=np.int32) - np.repeat(cut, width)
        equal = t[np.repeat(a[same], width) + step] == t[np.repeat(a[same - 1], width) + step]
        new[same] = ~np.logical_and.reduceat(equal, cut)
    names = np.empty(len(p), np.int64)
    names[which] = np.cumsum(new) - 1
    return names


def _induced(work) -> np.ndarray:
    p = work.leftmost
    if len(p) < 2:
        return work.sort(p)
    sa = work.sort(p)
    mark = np.zeros(len(work.t), bool)
    mark[p] = True
    names = _named(work.t, p, sa[mark[sa]])
    if names.max() + 1 == len(p):
        order = np.argsort(names)
    else:
        order = _induced(_Names(names))
    return work.sort(p[order])


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of bytes whose last one is smaller than all others and unique."""
    return _induced(_Induction(t))


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position: common prefix with the suffix that precedes it in ``sa``, and that suffix."""
    n = len(t)
    before = np.empty(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n - 1  # the smallest suffix shares nothing with anything
    at = np.arange(n, dtype=np.int32)
    whole = np.flatnonzero((at == 0) | (before == 0) | (t[at - 1] != t[before - 1]))
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), np.uint64, buffer=padded.data, strides=(1,))
    common = np.zeros(len(whole), np.int32)
    live = np.arange(len(whole))
    i, j = whole.copy(), before[whole]
    while len(live):
        x = words[i] ^ words[j]
        same = x == 0
        low = x & (~x + np.uint64(1))
        got = np.where(same, 8, np.log2(np.maximum(low, np.uint64(1)).astype(float)).astype(np.int64) >> 3)
        common[live] += got
        same &= np.maximum(i, j) + 8 < n
        live, i, j = live[same], i[same] + 8, j[same] + 8
    common = np.minimum(common, n - np.maximum(whole, before[whole]))
    lead = np.zeros(n, np.int32)
    lead[whole] = np.arange(len(whole))
    lead = np.maximum.accumulate(lead)
    return np.maximum(common[lead] - (at - whole[lead]), 0), before


def repeated(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """Per piece and start: does this string of ``length`` bytes also start elsewhere in the pieces?"""
    sizes = np.array([len(x) for x in pieces], np.int64)
    if not len(sizes):
        return []
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    t = np.frombuffer(b"\xff".join(pieces) + b"\xff\xfe", np.uint8) + np.uint8(2)  # 0xff and 0xfe are in no text
    sa = suffix_array(t)
    prefix, before = permuted_prefixes(t, sa)
    left = np.repeat(begin[:-1] + sizes, sizes + 1) - np.arange(begin[-1])
    hit = np.flatnonzero((prefix[:begin[-1]] >= length) & (left >= length))
    out = np.zeros(len(t), bool)
    out[hit] = True
    out[before[hit]] = True
    return [out[b:b + max(0, s - length + 1)] for b, s in zip(begin[:-1].tolist(), sizes.tolist())]
