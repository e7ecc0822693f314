"""Exact n-gram Jaccard self-join by parity sketches, with connected components.

A document's set holds the names of its distinct word n-grams.  Documents
link when |A ∩ B| / |A ∪ B| >= percent / 100.  Steps:

1. Equal sets form a class; only one representative of a class goes on.
2. Sizes fall into bands such that linked sets are in the same or neighbouring
   bands.  A band bounds the symmetric difference of a link by d.  A set is
   dealt to d + 1 blocks (and some spare) by hash, and each block is XOR-hashed.
   Linked sets differ in at most d blocks, so by the pigeonhole principle they
   share a block value: the join key is (band, block, value).  Linked sets share
   at least r = blocks - d values, so each set may leave out its r - 1 most
   frequent keys (a total order that all agree on): the rarest common key stays
   on both sides.  Empty blocks are left out first, then keys of large groups.
3. Groups of a key with few members give all their pairs; in larger ones every
   member meets one hub (the class with most copies).
4. A pair is screened by parity sketches: bit i tells whether an odd number of
   n-grams hash to i.  The Hamming distance of two sketches is at most the
   symmetric difference, so pairs further apart than a link allows go.  Only
   sketches have travelled so far; texts are lent for the pairs that are left,
   and exact intersections decide.
5. Members that link with the hub are one component.  Each of the others is
   screened against all members of its hub, again by sketches.  Of the pairs that
   are left the differences from the hub are compared: |x Δ y| = |(x Δ hub) Δ (y Δ
   hub)|, so an inverted index over these differences finds, exactly, whether two
   members link, without a row per pair.
6. Links give components.

Defined results: a null, empty or blank text has an empty set, links with
nothing and is its own component; fewer words than n make one n-gram of all;
a null doc_id comes back null, and counts for a component's smallest id only
where all its ids are null; rows with the same doc_id are separate documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .graph import components

#: Block keys only propose pairs, so 48 bits do; the others compress away.
_KEY = np.uint64(2**64 - 2**16)
_LOW = np.uint64(32)
_PLACE = (1 << C.REF_BITS) - 1


class Bands:
    """Size bands, the largest symmetric difference of a link, and the blocks of each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lower = [1]

    def of(self, n: int) -> int:
        while self.lower[-1] <= n:
            self.lower.append(self.lower[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.lower, n, "right")) - 1

    def difference(self, total):
        return total * (100 - self.percent) // (100 + self.percent)

    def shape(self, band: int) -> tuple[int, int]:
        """(d, number of blocks) of pairs whose larger set is in ``band``."""
        while len(self.lower) < band + 2:
            self.lower.append(self.lower[-1] * 100 // self.percent + 1)
        d = self.difference(2 * (self.lower[band + 1] - 1))
        return d, d + 1 + (d > 0) + d // 12

    def keys(self, shingles: np.ndarray, values: np.ndarray) -> list:
        """Block keys of a sorted set in its own band and, as the smaller set, in the next, each with how many may be left out."""
        own = self.of(len(shingles))
        out = []
        for band in (own, own + 1):
            d, m = self.shape(band)
            block = ((shingles >> _LOW) * np.uint64(m)) >> _LOW
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            xor = np.bitwise_xor.reduceat(values, first)
            block = block[first]
            spare = m - d - 1 - (m - len(block))
            if spare < 0:
                none = np.setdiff1d(np.arange(m, dtype=np.uint64), block)
                block, xor = np.append(block, none), np.append(xor, np.zeros(len(none), np.uint64))
            tag = C.mix((np.uint64(band) << _LOW) + block)
            out.append(((C.mix(xor ^ tag) + tag) & _KEY, max(spare, 0)))
        return out


class Sketches:
    """Parity sketches: a power of two of bits, some four for each difference that a link allows."""

    def __init__(self, percent: int):
        self.bands = Bands(percent)

    def words(self, size):
        """64-bit words of the sketch of a set of ``size``."""
        need = np.maximum(4 * self.bands.difference(2 * np.asarray(size, np.int64)), 256) / 64
        return (1 << np.ceil(np.log2(need)).astype(np.int64))

    def of(self, s: np.ndarray) -> np.ndarray:
        bits = 64 * int(self.words(len(s)))
        odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
        return np.packbits(odd).view(np.uint64)

    @staticmethod
    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hamming distance of a sketch from the rows of ``b``; the larger ones are folded to the smaller."""
        a = np.atleast_2d(a)
        width = min(a.shape[1], b.shape[1])
        return np.bitwise_count(folded(a, width) ^ folded(b, width)).sum(1, dtype=np.int64)


def folded(a: np.ndarray, width: int) -> np.ndarray:
    """Rows of sketches with their parts laid over each other: parities of fewer, larger cells."""
    return a if a.shape[1] == width else np.bitwise_xor.reduce(a.reshape(len(a), -1, width), axis=1)


def shingle_sets(chunk: C.Chunk, n: int, only=None, both: bool = False) -> list:
    """Per document the sorted names of its distinct n-grams (``only``: of these documents).

    With ``both`` each is a pair: the names, and their other halves in the same order.
    """
    w = chunk.words(lower=True)
    kinds = [(x, C.windows(x, n)) for x in ((w.name, w.other) if both else (w.name,))]
    out: list = [None] * len(chunk.ids)
    for i in range(len(chunk.ids)) if only is None else only:
        a, b = int(w.first[i]), int(w.first[i + 1])
        own = [g[a:b - n + 1] if b - a >= n else C.windows(x[a:b], b - a) if b > a else x[:0] for x, g in kinds]
        if both:
            names, first = np.unique(own[0], return_index=True)
            out[i] = names, own[1][first]
        else:
            out[i] = np.unique(own[0])
    return out


def _classes(keys, owner, columns):
    """Of each set fingerprint: who represents it (least id that is not null), and how often it occurs."""
    second, doc, null, ref, times = columns
    order = np.lexsort((ref, doc, null, second, keys))
    k, s = keys[order], second[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    total = np.add.reduceat(times[order].astype(np.int64), first) if len(first) else first
    out = []
    for column in (doc[order][first], null[order][first], ref[order][first], total):
        back = np.empty(len(keys), column.dtype)
        back[order] = column[group]
        out.append(back)
    return out, None


class _Local:
    """A chunk's classes: fingerprints and sketches of its distinct sets, and each document's class."""

    def __init__(self, chunk: C.Chunk, n: int, percent: int):
        sets = shingle_sets(chunk, n, both=True)
        self.size = np.array([len(s) for s, _ in sets], np.int64)
        full = np.flatnonzero(self.size)
        self.full = full
        cut = np.cumsum(self.size[full]) - self.size[full]
        one, two = (np.add.reduceat(C.mix(np.concatenate([sets[i][k] for i in full])), cut) if len(full)
                    else np.zeros(0, np.uint64) for k in (0, 1))
        ref = (np.int64(chunk.id) << C.REF_BITS) + full
        order = np.lexsort((ref, chunk.ids[full], chunk.null[full], two, one))
        o, t = one[order], two[order]
        new = np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])]) if len(o) else np.zeros(0, bool)
        self.member = np.empty(len(full), np.int64)
        self.member[order] = np.cumsum(new) - 1
        lead = order[new]
        self.columns = (o[new], t[new], chunk.ids[full][lead], chunk.null[full][lead].astype(np.uint8), ref[lead],
                        np.bincount(self.member, minlength=int(new.sum())).astype(np.uint32))
        place = np.sort(full[lead])
        sketch = Sketches(percent)
        self.sketches = (place, self.size[place], np.concatenate([np.zeros(0, np.uint64), *(sketch.of(sets[i][0]) for i in place)]))


class _Screen:
    """Sketches by reference, from their packed form."""

    def __init__(self, refs, size, flat, percent: int):
        self.refs, self.size = refs, size
        self.words = Sketches(percent).words(size)
        self.begin = np.cumsum(self.words) - self.words
        self.flat = flat

    def at(self, refs: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.refs, refs)

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        """Sketches of one width as rows."""
        return self.flat[self.begin[at][:, None] + np.arange(width)]

    def cut(self, at: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(self.flat[b:b + w] for b, w in zip(self.begin[at].tolist(), self.words[at].tolist()))])


def _distances(one: _Screen, i: np.ndarray, two: _Screen, j: np.ndarray) -> np.ndarray:
    """Hamming distances of pairs of sketches."""
    out = np.empty(len(i), np.int64)
    kind = one.words[i] * (1 << 32) + two.words[j]
    for k in np.unique(kind).tolist():
        own = np.flatnonzero(kind == k)
        for part in np.array_split(own, len(own) // 50_000 + 1):
            a, b = one.rows(i[part], k >> 32), two.rows(j[part], k & (2**32 - 1))
            width = min(a.shape[1], b.shape[1])
            out[part] = np.bitwise_count(folded(a, width) ^ folded(b, width)).sum(1)
    return out


def _pairs(group: np.ndarray, whole: np.ndarray, all_pairs: int):
    """Index pairs within the whole groups (sorted by group)."""
    n = len(group)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, all_pairs):
        i = np.arange(n - k) if n > k else np.zeros(0, np.int64)
        i = i[(group[i] == group[i + k]) & whole[group[i]]]
        left.append(i)
        right.append(i + k)
    return np.concatenate(left), np.concatenate(right)


def _compatible(a, b, percent):
    return np.minimum(a, b) * 100 >= np.maximum(a, b) * percent


PAIRS = "a long, b long"


def _pair_table(a, b):
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    both = np.unique(np.stack([lo, hi], 1), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
    return pa.table([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _asked(pairs: DataFrame) -> DataFrame:
    """Pairs and the chunk of their second."""
    return C.written(pairs.withColumn("to", F.shiftright("b", C.REF_BITS)))


def _wanted(asked: DataFrame) -> DataFrame:
    """What each chunk lends: a set goes once to a chunk, however many partners it has there."""
    return asked.select("a", "to").distinct().withColumn("chunk_id", F.shiftright("a", C.REF_BITS))


def _targets(want: pa.Table):
    """(chunk, references to lend to it) in order."""
    a, to = (want.column(c).to_numpy() for c in ("a", "to"))
    order = np.lexsort((a, to))
    a, to = a[order], to[order]
    ids, first = np.unique(to, return_index=True)
    return ids, np.split(a, first[1:]) if len(ids) else []


def _lent_and_told(sent: DataFrame, asked: DataFrame, *columns: str) -> DataFrame:
    """What was lent to a chunk, and the pairs it is asked about, as rows of one table."""
    none = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in columns]
    return sent.select("chunk_id", "payload", *none).unionByName(
        asked.select(F.col("to").alias("chunk_id"), F.lit(None).cast("binary").alias("payload"), *columns))


def _told(lent: pa.Table, *columns: str):
    """The payloads and, ordered by the first column, the pairs."""
    payloads = [C.unpack(p.as_py()) for p in lent.column("payload").drop_null()]
    rows = lent.filter(pa.array(np.array(lent.column("payload").is_null())))
    got = [rows.column(c).to_numpy(zero_copy_only=False) for c in columns]
    order = np.argsort(got[0], kind="stable")
    return payloads, [x[order] for x in got]


SCREENED = "a long, b long, hub boolean, near boolean, size long, sketch binary"


def screen(local: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, hub) whose sketches allow a link; of hub pairs all, with ``near`` and the member's sketch."""
    asked = _asked(pairs)
    bands = Bands(percent)

    def own(left: pa.Table) -> tuple[int, _Screen]:
        chunk_id = left.column("chunk_id")[0].as_py()
        place, size, flat = C.unpack(left.column("sketches")[0].as_py())
        return chunk_id, _Screen((np.int64(chunk_id) << C.REF_BITS) + place, size, flat, percent)

    def lend(left: pa.Table, want: pa.Table) -> pa.Table:
        if not left.num_rows or not want.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["chunk_id", "payload"])
        _, mine = own(left)
        ids, parts = _targets(want)
        rows = [C.pack(refs, mine.size[at], mine.cut(at)) for refs in parts for at in [mine.at(refs)]]
        return pa.table([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["chunk_id", "payload"])

    def judge(left: pa.Table, lent: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in SCREENED.split(", ")]
        if not left.num_rows or not lent.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary())], names=names)
        _, mine = own(left)
        payloads, (a, b, hub) = _told(lent, "a", "b", "hub")
        hub = hub.astype(bool)
        refs, size, flat = (np.concatenate(x) for x in zip(*payloads))
        order = np.argsort(refs, kind="stable")
        theirs = _Screen(refs, size, flat, percent)
        i, j = order[np.searchsorted(refs[order], a)], mine.at(b)
        near = _compatible(theirs.size[i], mine.size[j], percent)
        some = np.flatnonzero(near)
        near[some] = _distances(theirs, i[some], mine, j[some]) <= bands.difference(theirs.size[i[some]] + mine.size[j[some]])
        stay = np.flatnonzero(near | hub)
        sketch = [mine.flat[s:s + w].tobytes() if h else None for h, s, w in
                  zip(hub[stay].tolist(), mine.begin[j[stay]].tolist(), mine.words[j[stay]].tolist())]
        return pa.Table.from_arrays([pa.array(a[stay]), pa.array(b[stay]), pa.array(hub[stay]), pa.array(near[stay]),
                                     pa.array(mine.size[j[stay]]), pa.array(sketch, pa.binary())], names=names)

    groups = local.select("chunk_id", "sketches").groupBy("chunk_id")
    sent = groups.cogroup(_wanted(asked).groupBy("chunk_id")).applyInArrow(lend, "chunk_id long, payload binary")
    both = _lent_and_told(sent, asked, "a", "b", "hub")
    return C.written(groups.cogroup(both.groupBy("chunk_id")).applyInArrow(judge, SCREENED))


VERIFIED = ("a long, b long, doc_a long, null_a boolean, doc_b long, null_b boolean, link boolean, size_b long, difference binary")


def verify(chunks: DataFrame, pairs: DataFrame, n: int, percent: int, differences: bool = False) -> DataFrame:
    """Pairs of references (a, b) whose sets link, compared exactly; with ``differences`` all pairs, with a Δ b."""
    asked = _asked(pairs.select("a", "b"))

    def lend(chunk: C.Chunk, want: pa.Table) -> pa.Table:
        """Texts for the chunks of their partners: compressed, they are a fraction of their sets."""
        ids, parts = _targets(want)
        rows = []
        for own in parts:
            at = own & _PLACE
            body = b"".join([chunk.body[chunk.starts[i]:chunk.ends[i] + 1] for i in at.tolist()])
            rows.append(C.pack(own, chunk.ids[at], chunk.null[at].astype(np.uint8), chunk.lens[at], np.array([len(body)]),
                               np.frombuffer(pa.compress(body, "zstd", asbytes=True), np.uint8)))
        return pa.table([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["chunk_id", "payload"])

    def judge(chunk: C.Chunk, lent: pa.Table) -> pa.Table:
        out, extra = [], []
        if lent.num_rows:
            payloads, (first, second) = _told(lent, "a", "b")
            mine = shingle_sets(chunk, n, np.unique(second & _PLACE).tolist())
            for refs, ids, null, lens, size, body in payloads:
                text = pa.decompress(body.tobytes(), int(size[0]), "zstd", asbytes=True)
                sets = shingle_sets(C.Chunk(0, ids.tobytes() + null.tobytes(), lens.tobytes(), text, b""), n)
                begin, end = np.searchsorted(first, refs), np.searchsorted(first, refs, "right")
                for ref, doc, no, s, i, j in zip(refs.tolist(), ids.tolist(), null.tolist(), sets, begin.tolist(), end.tolist()):
                    for k in range(i, j):
                        at = int(second[k] & _PLACE)
                        t = mine[at]
                        total = len(s) + len(t)
                        short, long = (s, t) if len(s) <= len(t) else (t, s)
                        common = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
                        link = common * 100 >= (total - common) * percent
                        if link or differences:
                            out.append((ref, second[k], doc, no, chunk.ids[at], chunk.null[at], link and ref != second[k], len(t)))
                            extra.append(np.setxor1d(s, t, assume_unique=True).tobytes() if differences else None)
        columns = np.array(out, np.int64).reshape(len(out), 8).T
        flag = lambda x: pa.array(x.astype(bool))
        return pa.table([*(pa.array(c) for c in columns[:3]), flag(columns[3]), pa.array(columns[4]), flag(columns[5]), flag(columns[6]),
                         pa.array(columns[7]), pa.array(extra, pa.binary())], names=[x.split()[0] for x in VERIFIED.split(", ")])

    sent = C.with_answers(chunks, _wanted(asked), lend, "chunk_id long, payload binary")
    return C.written(C.with_answers(chunks, _lent_and_told(sent, asked, "a", "b"), judge, VERIFIED))


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """Members (a, b, link, ...) of the hubs that have unlinked ones: dealt to blocks, and each unlinked one, as a probe, to all of them."""
    mixed = members.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"), F.bool_and("link").alias("all_linked"))
    rows = members.join(mixed.where("not all_linked").select("a", "blocks"), "a")
    own = F.array(F.struct(F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.lit(False).alias("probe")))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.struct(i.alias("block"), F.lit(True).alias("probe")))
    return (rows.withColumn("deal", F.explode(F.when(F.col("link"), own).otherwise(F.concat(own, every))))
            .select("*", "deal.*").drop("deal", "blocks"))


def _feasible(members: DataFrame, percent: int, block: int = 20_000) -> DataFrame:
    """(a, b): members b of hub a of which some pair, one of it not linked with the hub, has sketches that allow a link."""
    bands = Bands(percent)

    def run(table: pa.Table) -> pa.Table:
        b, size, probe = (table.column(c).to_numpy(zero_copy_only=False) for c in ("b", "size", "probe"))
        raw = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("sketch")]
        width = min(len(x) for x in raw)
        rows = np.stack([folded(x[None], width)[0] for x in raw])
        target = np.flatnonzero(~probe.astype(bool))
        t_rows, t_size, t_ref = rows[target], size[target], b[target]
        found = np.zeros(len(b), bool)
        for x in np.flatnonzero(probe).tolist():
            ok = np.flatnonzero(_compatible(size[x], t_size, percent) & (t_ref != b[x]))
            near = ok[Sketches.apart(rows[x], t_rows[ok]) <= bands.difference(size[x] + t_size[ok])] if len(ok) else ok
            found[target[near]] = True
            found[x] |= len(near) > 0
        return pa.table([table.column("a").filter(pa.array(found)), pa.array(b[found])], names=["a", "b"])

    return _dealt(members, block).groupBy("a", "block").applyInArrow(run, PAIRS).distinct()


JOINING = "a long, b long, doc_a long, null_a boolean, doc_b long, null_b boolean"


def _through_hubs(spread: DataFrame, percent: int, block: int = 20_000) -> DataFrame:
    """Links among members of a hub, found from their differences from it.

    Within a task only links that join components are returned, so rows stay linear.
    """

    def resolve(table: pa.Table) -> pa.Table:
        b, doc, null, size, link, probe = (table.column(c).to_numpy(zero_copy_only=False)
                                           for c in ("b", "doc_b", "null_b", "size_b", "link", "probe"))
        link, probe = link.astype(bool), probe.astype(bool)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("difference")]
        lens = np.array([len(x) for x in sets], np.int64)
        out = []
        target = np.flatnonzero(~probe)
        flat, owner = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in target)]), np.repeat(target, lens[target])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        _, parent = np.unique(b, return_index=True)
        parent = parent[np.searchsorted(np.sort(np.unique(b)), b)]  # a probe and its own row are one node
        if link.any():
            parent[link] = np.flatnonzero(link)[0]

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for x in np.flatnonzero(probe).tolist():
            lo, hi = np.searchsorted(flat, sets[x]), np.searchsorted(flat, sets[x], "right")
            width = hi - lo
            near = owner[np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum())]
            shared = np.bincount(near, minlength=len(sets))[target]
            apart_by = lens[x] + lens[target] - 2 * shared
            total = size[x] + size[target]
            # |A ∩ B| = (|A| + |B| - |A Δ B|) / 2
            ok = ((total - apart_by) * 100 >= (total + apart_by) * percent) & (b[target] != b[x])
            for y in target[ok].tolist():
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[rx] = ry
                    out.append((b[x], b[y], doc[x], null[x], doc[y], null[y]))
        columns = np.array(out, np.int64).reshape(len(out), 6).T
        kinds = [x.split() for x in JOINING.split(", ")]
        return pa.table([pa.array(c.astype(bool)) if kind == "boolean" else pa.array(c) for c, (_, kind) in zip(columns, kinds)],
                        names=[name for name, _ in kinds])

    return _dealt(spread, block).groupBy("a", "block").applyInArrow(resolve, JOINING)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class Join:
    """The self-join of ``docs``: run once, then read as classes or as kept documents.

    Groups of a key with more than ``all_pairs`` members go through a hub.
    """

    def __init__(self, docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
                 text_col: str = "text", carry: tuple = (), all_pairs: int = 16):
        spark = docs.sparkSession
        self.docs, self.carry, self.text_col, self.id_col = docs, carry, text_col, id_col
        self.chunks = C.chunked(docs, id_col, text_col, carry=carry)
        nb = C.n_buckets(spark, self.chunks.select("chunk_id").count())

        def prints(batches):
            for chunk in C.chunks_of(batches):
                local = _Local(chunk, n, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk.id]),
                     pa.array([C.pack(chunk.ids, chunk.null.astype(np.uint8), local.size, local.full, local.member, *local.columns)], pa.binary()),
                     pa.array([C.pack(*local.sketches)], pa.binary())],
                    names=["chunk_id", "payload", "sketches"])

        def to_buckets(batches):
            for batch in batches:
                for chunk_id, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield C.blocks(chunk_id, nb, *C.unpack(payload.as_py())[5:])

        self.local = C.written_by(self.chunks.mapInArrow(prints, "chunk_id long, payload binary, sketches binary"), "chunk_id")
        self.classes = C.written(C.reduced(self.local.select("chunk_id", "payload").mapInArrow(to_buckets, C.BLOCK_SCHEMA), _classes))

        def keyed(chunk: C.Chunk, answers: pa.Table):
            """Keys of the representatives here, sorted: key, place, size, copies, and the set's side (band) with its spare keys."""
            got = C.gathered(answers)
            rep, times = got[2:] if got else (np.zeros(0, np.int64),) * 2
            here = rep >> C.REF_BITS == chunk.id
            sets = shingle_sets(chunk, n, (rep[here] & _PLACE).tolist()) if here.any() else []
            bands = Bands(percent)
            every, rows = [np.zeros(0, np.uint64)], []
            for r, c in zip(rep[here].tolist(), times[here].tolist()):
                s = sets[r & _PLACE]
                for side, (k, spare) in enumerate(bands.keys(s, C.mix(s))):
                    every.append(k)
                    rows.append((len(k), r & _PLACE, len(s), c, side, spare))
            keys, rows = np.concatenate(every), np.array(rows, np.int64).reshape(-1, 6)
            of = np.repeat(np.arange(len(rows)), rows[:, 0])
            order = np.lexsort((rows[of, 1], -rows[of, 3], keys)) if len(keys) else of
            return keys[order], *rows[of[order], 1:].T

        def local_groups(keys):
            new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(keys)))
            return np.cumsum(new) - 1, first, count

        def send(chunk: C.Chunk, answers: pa.Table) -> pa.Table:
            keys, place, size, copies, _, _ = keyed(chunk, answers)
            group, first, count = local_groups(keys)
            cut = count > all_pairs
            hub = np.zeros(len(keys), bool)
            hub[first] = True
            go = hub | ~cut[group] if len(keys) else hub
            stand = np.where(cut[group], count[group], 1) if len(keys) else count  # members that a row stands for
            return pa.Table.from_batches([C.blocks(
                chunk.id, nb, keys[go], place[go].astype(np.uint32), size[go].astype(np.uint32),
                np.minimum(copies[go], 2**31).astype(np.uint32), stand[go].astype(np.uint32))])

        def meet(table: pa.Table) -> pa.Table:
            got = [(i, C.unpack(p)) for i, p in zip(table.column("chunk_id").to_pylist(), table.column("payload").to_pylist())]
            key, place, size, copies, stand = (np.concatenate(x) for x in zip(*(g for _, g in got)))
            chunk_id = np.repeat([i for i, _ in got], [len(g[0]) for _, g in got])
            ref = (chunk_id << C.REF_BITS) + place.astype(np.int64)
            order = np.lexsort((ref, -copies.astype(np.int64), key))
            key, ref, size = key[order], ref[order], size[order].astype(np.int64)
            group, first, _ = local_groups(key)
            members = np.add.reduceat(stand[order].astype(np.int64), first)
            whole = members <= all_pairs
            left, right = _pairs(group, whole, all_pairs)
            ok = _compatible(size[left], size[right], percent)
            pairs = _pair_table(ref[left[ok]], ref[right[ok]])
            # chunks with members of a larger group are told its hub and size
            part = np.flatnonzero(~whole[group])
            owner = ref[part] >> C.REF_BITS
            told = []
            for c in np.unique(owner):
                mine = part[owner == c]
                keys_, one = np.unique(key[mine], return_index=True)
                of = group[mine][one]
                told.append((int(c), C.pack(keys_, ref[first[of]], members[of])))
            return pa.table([
                pa.array([None] * pairs.num_rows + [c for c, _ in told], pa.int64()),
                pa.concat_arrays([*pairs.column("a").chunks, pa.nulls(len(told), pa.int64())]),
                pa.concat_arrays([*pairs.column("b").chunks, pa.nulls(len(told), pa.int64())]),
                pa.array([None] * pairs.num_rows + [p for _, p in told], pa.binary())],
                names=["chunk_id", "a", "b", "payload"])

        sent = C.with_answers(self.chunks, self.classes, send, C.BLOCK_SCHEMA)
        met = C.written(sent.groupBy("bucket").applyInArrow(meet, "chunk_id long, a long, b long, payload binary"))
        small = met.where("chunk_id is null").select("a", "b")
        opened = met.where("chunk_id is not null").select("chunk_id", "payload", F.lit(-1).alias("bucket"))

        def members(chunk: C.Chunk, answers: pa.Table) -> pa.Table:
            """(hub, member) for the members here of larger groups, by the keys that they do not leave out."""
            own = np.array(answers.column("bucket")) >= 0
            both = np.zeros((0, 2), np.int64)
            if not own.all():
                told = [C.unpack(p.as_py()) for p in answers.filter(pa.array(~own)).column("payload")]
                key, hub, times = (np.concatenate(x) for x in zip(*told))
                order = np.argsort(key)
                key, hub, times = key[order], hub[order], times[order]
                keys, place, _, _, side, spare = keyed(chunk, answers.filter(pa.array(own)))
                at = np.minimum(np.searchsorted(key, keys), len(key) - 1)
                big = np.flatnonzero(key[at] == keys)
                at, place, side, spare, keys = at[big], place[big], side[big], spare[big], keys[big]
                order = np.lexsort((keys, times[at], side, place))[::-1]  # of each set the most frequent keys first
                who = place[order] * 2 + side[order]
                new = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else who
                rank = np.arange(len(who)) - np.repeat(new, np.diff(np.append(new, len(who))))
                stay = order[rank >= spare[order]]
                both = np.stack([hub[at[stay]], (np.int64(chunk.id) << C.REF_BITS) + place[stay]], 1)
                both = np.unique(both[both[:, 0] != both[:, 1]], axis=0)
            return pa.table([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        stars = C.with_answers(self.chunks, self.classes.unionByName(opened), members, PAIRS)
        pairs = small.distinct().withColumn("hub", F.lit(False)).unionByName(stars.withColumn("hub", F.lit(True)))
        screened = screen(self.local, pairs, percent)
        linked = verify(self.chunks, screened.where("near").select("a", "b").distinct(), n, percent).where("link").select(*_names(JOINING))
        linked_hub = linked.select("a", "b", F.lit(True).alias("linked"))
        spread = (screened.where("hub").join(linked_hub, ["a", "b"], "left")
                  .select("a", "b", "size", "sketch", F.coalesce("linked", F.lit(False)).alias("link")))
        open_ = C.written(_feasible(spread, percent))
        found = verify(self.chunks, open_, n, percent, differences=True)
        links = C.written(linked.unionByName(_through_hubs(found, percent)))
        roots = components(links.select("a", "b"))
        nodes = links.selectExpr("a as node", "null_a as none", "doc_a as doc").unionByName(
            links.selectExpr("b as node", "null_b as none", "doc_b as doc")).distinct()
        best = nodes.join(roots, "node").groupBy("root").agg(F.min(F.struct("none", "doc", "node")).alias("best"))
        self.labels = roots.join(best, "root").select("node", "best")
        self.links = links

    def documents(self) -> DataFrame:
        """Per document: doc_id, n_shingles, component_id, and its own, its component's first and its class's reference."""

        def told(left: pa.Table, right: pa.Table) -> pa.Table:
            chunk_id = left.column("chunk_id")[0].as_py()
            ids, null, size, full, member = C.unpack(left.column("payload")[0].as_py())[:5]
            got = C.gathered(right)
            own = (np.int64(chunk_id) << C.REF_BITS) + np.arange(len(ids))
            rep, doc, none = own.copy(), ids.copy(), null.copy()
            if got:
                doc[full], none[full], rep[full] = (x[member] for x in got[:3])
            return pa.table([pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(size), pa.array(own), pa.array(rep),
                             pa.array(doc, pa.int64(), mask=none.astype(bool))],
                            names=["doc_id", "n_shingles", "own", "rep", "rep_doc"])

        rows = (self.local.select("chunk_id", "payload").groupBy("chunk_id").cogroup(self.classes.groupBy("chunk_id"))
                .applyInArrow(told, "doc_id long, n_shingles long, own long, rep long, rep_doc long"))
        out = rows.join(self.labels, rows.rep == self.labels.node, "left")
        component = F.when(F.col("best").isNull(), F.col("rep_doc")).when(~F.col("best.none"), F.col("best.doc"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"),
                          "own", F.coalesce("best.node", "rep").alias("first"), "rep")

    def kept(self) -> DataFrame:
        """The documents (id, text, carried columns) that come first in their component."""
        stay = self.documents().where("own = first").select(F.shiftright("own", C.REF_BITS).alias("chunk_id"), "own")

        def cut(chunk: C.Chunk, answers: pa.Table) -> pa.Table:
            at = np.sort(answers.column("own").to_numpy() & _PLACE)
            texts = pa.array([chunk.text(i) for i in at.tolist()], pa.binary()).cast(pa.string())
            rest = chunk.rest().take(pa.array(at))
            return pa.Table.from_arrays([chunk.ids_column().take(pa.array(at)), texts, *rest.columns], names=schema.names)

        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                               *(T.StructField(f"c{i}", self.docs.schema[c].dataType) for i, c in enumerate(self.carry))])
        return C.with_answers(self.chunks, stay, cut, schema).toDF(self.id_col, self.text_col, *self.carry)


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
         all_pairs: int = 16) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    return Join(docs, n, percent, id_col, text_col, all_pairs=all_pairs).documents().select("doc_id", "n_shingles", "component_id")
