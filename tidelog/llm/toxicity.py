"""Toxicity by a lexicon whose misspellings a Levenshtein automaton accepts.

The lexicon is a trie of terms.  A term is a whole word or a stem (any word that
begins with it).  The automaton of one edit runs over the trie: its states are
sets of (trie node, edits so far), made as texts ask for them and kept in a table,
so that all words of a chunk advance together, one character a step, and a large
lexicon costs only the states that occur.  Terms and stems shorter than
``fuzzy_from`` letters must match exactly; the tail of a stem is free.

A hit counts by its context window: inside quotation marks, or a few words after
a word of reporting, it counts ``quoted`` times a direct hit.  A logistic curve
over the weighted evidence gives the score.

Lexicon, weights, the share of a quoted hit and curve are fitted on at most
``max_docs`` labelled documents outside the held-out fold, drawn by a hash of
their id and read whole; of copies and near copies one is read.

Defined results: an empty or null text has no evidence and gets the curve's low
end; a null doc_id comes back null; with no labels to learn from all score 0;
labels other than 0 and 1 are not read, nor is an id that is labelled both.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .langid import points, tables

#: Words after which a term is reported rather than used; fixed values.
REPORTING = ("said", "says", "called", "calls", "wrote", "quote", "quoted", "word", "term", "slur",
             "dit", "mot", "sagte", "wort", "dijo", "palabra")
_QUOTES = np.array([ord(c) for c in "\"“”«»„"])
#: A quoted hit is presumed to count so much; the sample outweighs that as it shows more of them.
QUOTED, QUOTED_DOCS = 0.3, 20


class Automaton:
    """The one-edit automaton of a trie of terms, with a table over character classes that grows as words are read."""

    def __init__(self, words: list[str], stems: list[str], fuzzy_from: int = 5):
        self.terms = [(w, "word") for w in words] + [(s, "stem") for s in stems]
        self.fuzzy_from = fuzzy_from
        self.nodes: list[dict] = [{}]
        self.fuzzy = set()
        self.term_of: dict[int, list[int]] = {}
        for i, (term, _) in enumerate(self.terms):
            at, path = 0, [0]
            for c in term:
                if c not in self.nodes[at]:
                    self.nodes.append({})
                    self.nodes[at][c] = len(self.nodes) - 1
                at = self.nodes[at][c]
                path.append(at)
            self.term_of.setdefault(at, []).append(i)
            if len(term) >= fuzzy_from:
                self.fuzzy.update(path)
        self.chars = [None, *sorted({c for t, _ in self.terms for c in t})]
        self.classes = np.zeros(0x110000, np.int32)
        for k, c in enumerate(self.chars[1:], 1):
            self.classes[ord(c)] = k
        self.states, self.number = [], {}
        self.table = np.zeros((0, len(self.chars)), np.int32)
        self.accept, self.exact = np.zeros(0, np.int32), np.zeros(0, bool)
        self._number(frozenset())
        self._number(self._closed({(0, 0, -1)}))

    def __reduce__(self):
        """Tasks of a worker share one automaton, so that its table grows once."""
        of = lambda kind: tuple(t for t, k in self.terms if k == kind)
        return _shared, (of("word"), of("stem"), self.fuzzy_from)

    def _closed(self, states):
        """With deletions (a fuzzy node may be entered without reading its character) and finished stems."""
        out = set(states)
        for node, edits, stem in states:
            if edits == 0 and stem < 0 and node in self.fuzzy:
                out.update((n, 1, -1) for n in self.nodes[node].values() if n in self.fuzzy)
        for node, edits, stem in list(out):
            if stem < 0:
                out.update((0, edits, i) for i in self.term_of.get(node, ()) if self._accepts(i, edits) and self.terms[i][1] == "stem")
        return frozenset(out)

    def _accepts(self, term: int, edits: int) -> bool:
        return edits == 0 or len(self.terms[term][0]) >= self.fuzzy_from

    def _step(self, states, c):
        out = set()
        for node, edits, stem in states:
            if stem >= 0:  # a stem has been read: the rest of the word is free
                out.add((node, edits, stem))
                continue
            for d, n in self.nodes[node].items():
                if d == c:
                    if edits == 0 or n in self.fuzzy:
                        out.add((n, edits, -1))
                elif edits == 0 and n in self.fuzzy:
                    out.add((n, 1, -1))
            if edits == 0 and node in self.fuzzy:
                out.add((node, 1, -1))
        return self._closed(out)

    def _number(self, states) -> int:
        k = self.number.get(states)
        if k is None:
            k = self.number[states] = len(self.states)
            self.states.append(states)
            if k == len(self.table):
                more = max(64, k)
                self.table = np.concatenate([self.table, np.full((more, len(self.chars)), -1, np.int32)])
                self.accept, self.exact = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.accept, self.exact))
            best = max(((-edits, len(self.terms[i][0]), -i) for node, edits, stem in states
                        for i in ([stem] if stem >= 0 else self.term_of.get(node, ()))
                        if stem >= 0 or self.terms[i][1] == "word" and self._accepts(i, edits)), default=None)
            self.accept[k] = -best[2] if best else -1
            self.exact[k] = bool(best and best[0] == 0)
            if not states:
                self.table[k] = k
        return k

    def match(self, cls: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Per word: its term (-1: none), and whether it matches without an edit."""
        state = np.ones(len(start), np.int32)
        live = np.arange(len(start))
        k = 0
        while len(live):
            at = start[live] + k
            live, at = live[at < end[live]], at[at < end[live]]
            to = self.table[state[live], cls[at]]
            if (to < 0).any():
                asked = np.unique(state[live][to < 0].astype(np.int64) * len(self.chars) + cls[at][to < 0])
                for s, c in zip(*(x.tolist() for x in np.divmod(asked, len(self.chars)))):
                    new = self._number(self._step(self.states[s], self.chars[c]))
                    self.table[s, c] = new
                to = self.table[state[live], cls[at]]
            state[live] = to
            live = live[to > 0]
            k += 1
        return self.accept[state], self.exact[state]


@lru_cache(maxsize=2)
def _shared(words: tuple, stems: tuple, fuzzy_from: int) -> Automaton:
    return Automaton(list(words), list(stems), fuzzy_from)


@dataclass
class Model:
    automaton: Automaton | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  # term -> inexact, exact
    curve: tuple = (0.0, 0.0, -8.0)
    quoted: float = QUOTED
    reporting: tuple = REPORTING


def _words(chunk: C.Chunk):
    """Lower-case code points, and runs of letters and digits: start, end, document bounds."""
    code, begins = points(chunk)
    lower, letter, _ = tables()
    low = lower[code]
    inside = letter[code] | ((code >= 48) & (code <= 57))
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    return code, low, begins, start, end


def _in_quotes(code: np.ndarray, begins: np.ndarray, at: np.ndarray, reach: int = 120) -> np.ndarray:
    """Is a quotation open before each place: an odd number of marks so far, the last one near?"""
    mark = np.isin(code, _QUOTES)
    count = np.concatenate([[0], np.cumsum(mark)])
    places = np.flatnonzero(mark)
    doc = np.searchsorted(begins, at, "right") - 1
    odd = (count[at] - count[begins[doc]]) % 2 == 1
    last = places[np.maximum(count[at] - 1, 0)] if len(places) else np.zeros(len(at), np.int64)
    return odd & (at - last <= reach)


def _reported(low, begins, start, end, hit, reporting) -> np.ndarray:
    """Is a word of reporting among the three words before each hit, in its document?"""
    out = np.zeros(len(hit), bool)
    doc = np.searchsorted(begins, start[hit], "right") - 1
    longest = max(map(len, reporting), default=0)
    for k in range(1, 4):
        before = hit - k
        at = np.maximum(before, 0)
        ok = (before >= 0) & (start[at] >= begins[doc]) & (end[at] - start[at] <= longest)
        for i in np.flatnonzero(ok).tolist():
            out[i] |= low[start[before[i]]:end[before[i]]].tobytes().decode("utf-32-le", "replace") in reporting
    return out


class Hits:
    """A chunk's hits: document, term, exact or not, and whether its window makes it a quotation."""

    def __init__(self, chunk: C.Chunk, automaton: Automaton, reporting: tuple):
        code, low, begins, start, end = _words(chunk)
        self.n_words = np.diff(np.searchsorted(start, begins))
        term, exact = automaton.match(automaton.classes[low], start, end)
        hit = np.flatnonzero(term >= 0)
        self.doc = np.searchsorted(begins, start[hit], "right") - 1
        self.term, self.exact = term[hit], exact[hit].astype(int)
        self.quoted = _reported(low, begins, start, end, hit, reporting) | _in_quotes(code, begins, start[hit])


def evidence(chunk: C.Chunk, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Weighted hits and words of each document."""
    if model.automaton is None:
        return np.zeros(len(chunk.ids)), np.zeros(len(chunk.ids))
    hits = Hits(chunk, model.automaton, model.reporting)
    worth = model.weights[hits.term, hits.exact] * np.where(hits.quoted, model.quoted, 1.0)
    return np.bincount(hits.doc, worth, len(chunk.ids)).astype(float), hits.n_words


def _sample(docs, labels, folds, held_out_fold, max_docs, id_col, text_col):
    """(text, toxic) of at most ``max_docs`` labelled documents outside the held-out fold, near copies mostly once."""
    one = (labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("toxic"))
           .where("i is not null and toxic in (0, 1)")
           .groupBy("i").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("top")).where("toxic = top").drop("top")
           .where(F.crc32(F.col("i").cast("string").cast("binary")) % folds != held_out_fold))
    chosen = one.orderBy(F.xxhash64("i"), "i").limit(max_docs)
    rows = [(r.i, r.toxic) for r in chosen.collect()]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(rows, "i long, toxic int"))
    texts = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].cast("string").alias("t"))
    sample = C.written(texts.join(chosen, "i"))
    family = sample.select("i", "t", "toxic").mapInArrow(_families, "i long, toxic int, family long")
    one = family.groupBy("family", "toxic").agg(F.min("i").alias("i")).select("i", "toxic")
    return C.written(sample.join(F.broadcast(one), ["i", "toxic"]).groupBy("i", "toxic").agg(F.first("t").alias("t")).select("i", "t", "toxic"))


def _families(batches):
    """Of each document the least name of its five-word shingles (of all its words, if fewer): near copies mostly share it."""
    for chunk, carried in C.pieces(batches):
        words = chunk.words(lower=True)
        names = C.windows(words.name, 5)
        out = np.zeros(len(chunk.ids), np.int64)
        for i, (a, b) in enumerate(zip(words.first.tolist(), words.first[1:].tolist())):
            own = names[a:b - 4] if b - a >= 5 else C.windows(words.name[a:b], b - a) if b > a else np.zeros(1, np.uint64)
            out[i] = own.min().astype(np.int64)
        yield pa.RecordBatch.from_arrays([chunk.ids_column(), carried.column(0).combine_chunks(), pa.array(out)], names=["i", "toxic", "family"])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1, max_docs: int = 12_000,
        letters: tuple = (2, 40), stems_of: tuple = (4, 8), certain: float = 15.0,
        id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn lexicon, term weights and curve from at most ``max_docs`` labelled documents.

    A term has ``letters`` (least, most), a stem ``stems_of``; it is in the lexicon
    if its log ratio of toxic to clean documents is above 3, the likelihood ratio
    statistic of that difference is above ``certain`` (by chance: one word in 10,000).
    Near copies are read once, as their rare words would only be memorised.
    """
    sample = _sample(docs, labels, folds, held_out_fold, max_docs, id_col, text_col)

    def terms(batches):
        """Documents of each label that hold a word, or a word with the stem."""
        for chunk, carried in C.pieces(batches):
            _, low, begins, start, end = _words(chunk)
            first = np.searchsorted(start, begins)
            raw = low.tobytes().decode("utf-32-le", "replace")
            counts: dict = {}
            for i, toxic in enumerate(carried.column(0).to_pylist()):
                seen = {raw[s:e] for s, e in zip(start[first[i]:first[i + 1]].tolist(), end[first[i]:first[i + 1]].tolist())}
                own = {("w", w) for w in seen if letters[0] <= len(w) <= letters[1]}
                own |= {("s", w[:k]) for w in seen for k in range(stems_of[0], stems_of[1] + 1) if len(w) >= k}
                for t in own:
                    counts.setdefault(t, [0, 0])[toxic] += 1
            flat = [(k, w, a, b) for (k, w), (a, b) in counts.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in flat], kind) for j, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))],
                names=["kind", "term", "clean", "toxic"])

    total = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = total.get(1, 0), total.get(0, 0)
    if not n_toxic or not n_clean:
        return Model()
    found = (sample.selectExpr("i", "t", "toxic").mapInArrow(terms, "kind string, term string, clean long, toxic long")
             .groupBy("kind", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    lift = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    share = (n_toxic + n_clean) / (F.col("toxic") + F.col("clean"))
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * share / n)).otherwise(0.0)
    unlike = 2 * (part("toxic", n_toxic) + part("clean", n_clean))
    # no more rows than the sample has words
    rows = (found.where(F.col("toxic") >= max(3, n_toxic // 200)).withColumn("lift", lift)
            .where((F.col("lift") > 3) & (unlike > certain)).orderBy(
                F.desc(F.col("toxic") * F.col("lift")), F.desc("kind"), F.desc(F.length("term")), "term").collect())
    words, stems, seen = [], [], {}
    for r in rows:  # what a chosen stem covers adds nothing (a misspelling of it meets the stem), nor does the stem of chosen words
        if any(r.term[:k] in stems for k in range(stems_of[0], len(r.term) + 1)) or r.kind == "s" and sum(
                seen[w] for w in words if w.startswith(r.term)) >= 0.9 * r.toxic:
            continue
        (words if r.kind == "w" else stems).append(r.term)
        seen[r.term] = r.toxic
    automaton = Automaton(words, stems)
    model = Model(automaton)
    narrow = sample.selectExpr("i", "t", "toxic")
    n_terms = len(automaton.terms)

    def weigh(batches):
        """Documents of each label with an exact or an inexact hit of a term, with a direct one, or with quoted ones only."""
        for chunk, carried in C.pieces(batches):
            hits = Hits(chunk, automaton, model.reporting)
            toxic = np.array(carried.column(0).to_pylist(), np.int64)
            direct = np.unique(hits.doc[~hits.quoted])
            quoted = np.setdiff1d(hits.doc, direct)
            own = np.unique(np.stack([hits.doc, 2 * hits.term + hits.exact], 1), axis=0)
            doc = np.concatenate([own[:, 0], direct, quoted]).astype(np.int64)
            key = np.concatenate([own[:, 1], np.full(len(direct), 2 * n_terms), np.full(len(quoted), 2 * n_terms + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(toxic[doc])], names=["k", "toxic"])

    value = np.full(2 * n_terms + 2, np.nan)
    n_quoted = 0
    for r in (narrow.mapInArrow(weigh, "k long, toxic long").groupBy("k")
              .agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()):
        value[r.k] = np.log((r.toxic + 0.5) / (n_toxic + 1)) - np.log((r.n - r.toxic + 0.5) / (n_clean + 1))
        if r.k == 2 * n_terms + 1:
            n_quoted = r.n
    if n_quoted and value[-2] > 0:
        share = min(max(value[-1] / value[-2], 0.0), 1.0)
        model.quoted = (n_quoted * share + QUOTED_DOCS * QUOTED) / (n_quoted + QUOTED_DOCS)
    weights = np.where(value[:-2] > 1.5, value[:-2], np.where(np.isnan(value[:-2]), np.nan, 0.0)).reshape(-1, 2)
    weights[:, 1] = np.nan_to_num(weights[:, 1])
    # a misspelling that the sample does not show is presumed to count 0.7 times the term
    weights[:, 0] = np.where(np.isnan(weights[:, 0]), 0.7 * weights[:, 1], weights[:, 0])
    model.weights = weights

    def gather(batches):
        for chunk, carried in C.pieces(batches):
            e, n = evidence(chunk, model)
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.float64()), pa.array(n, pa.float64()), carried.column(0).combine_chunks().cast(pa.int64())],
                                             names=["e", "n", "toxic"])

    levels = narrow.mapInArrow(gather, "e double, n double, toxic long").orderBy("e", "n", "toxic").toPandas()  # a row for each of the sample
    e, n, y = (levels[c].to_numpy(float) for c in ("e", "n", "toxic"))
    model.curve = _logistic(np.stack([np.log1p(e), np.log1p(n), np.ones(len(e))], 1), y, np.ones(len(e)))
    return model


def _logistic(x, y, w, rounds: int = 200, ridge: float = 0.05) -> tuple:
    """Weights by Newton's method with a small ridge; that of the evidence is kept positive."""
    a = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ a))
        g = x.T @ (w * (p - y)) + ridge * a
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(a))
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a = a - move
        a[0] = max(a[0], 0.01)
        if np.abs(move).max() < 1e-8:
            break
    return tuple(a.tolist())


def _scores(chunk: C.Chunk, model: Model) -> tuple[np.ndarray, np.ndarray]:
    a, per_length, b = model.curve
    e, n = evidence(chunk, model)
    p = 1 / (1 + np.exp(-(a * np.log1p(e) + per_length * np.log1p(n) + b)))
    return e, p if model.automaton is not None else np.zeros(len(e))


def clean(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that score below ``threshold``."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            below = [_scores(chunk, model)[1] < threshold for chunk, _ in C.pieces([batch.select([id_col, text_col])])]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *below])))

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, evidence and score (0 to 1)."""

    def run(batches):
        for chunk, _ in C.pieces(batches):
            e, p = _scores(chunk, model)
            yield pa.RecordBatch.from_arrays([chunk.ids_column(), pa.array(e), pa.array(p)], names=["doc_id", "evidence", "score"])

    narrow = docs.select(docs[id_col].cast("long").alias("a"), docs[text_col].cast("string").alias("b"))
    return narrow.mapInArrow(run, "doc_id long, evidence double, score double")
