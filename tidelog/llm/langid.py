"""Language spans of mixed text: script ranges, per-word scores, Viterbi.

Scripts (Unicode ranges of all planes) narrow a word's candidates to languages
that use its script in training.  A word's score under a language is the sum over
its letter trigrams, of code points, of their log probability relative to the mean
of the languages; a chunk's distinct words are scored once.  A Viterbi pass over a
document's words pays ``penalty`` for each change of language and so labels spans.
Most documents need no pass: if no language gains more than half the penalty on
the best one over any run of words, a constant label is optimal (m changes make
m + 1 runs), and that test is a running minimum over all documents of a chunk.

The model is fitted on at most ``max_docs`` labelled documents outside the
held-out fold, chosen by a hash of their id; everything is labelled.

Defined results: ``und`` and score 0 for a null text, an empty one or one
without letters; with nothing to learn from every document is ``und``; a null
doc_id comes back null; ties go to the language that is first by name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: First code point of each range and its script; fixed values.
SCRIPTS = ((0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
           (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"),
           (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
           (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
           (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
           (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1C80, "Cyrillic"),
           (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2C60, "Latin"), (0x2D00, "Georgian"), (0x2D80, "Ethiopic"),
           (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x31F0, "Kana"), (0x3400, "Han"),
           (0xA000, "Yi"), (0xA640, "Cyrillic"), (0xA720, "Latin"), (0xAC00, "Hangul"), (0xF900, "Han"),
           (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF21, "Latin"), (0xFF66, "Kana"),
           (0x10330, "Gothic"), (0x10400, "Deseret"), (0x10450, "Other"), (0x1E900, "Adlam"), (0x1EE00, "Arabic"), (0x20000, "Han"))
NAMES = sorted({name for _, name in SCRIPTS})
_TOP = 0x110000
#: Planes from here on have no letters.
_LAST = 0x40000


def _tables():
    """Per code point: lower case, is it a letter, which script."""
    lower = np.arange(_TOP, dtype=np.int32)
    letter = np.zeros(_TOP, bool)
    for c in range(_LAST):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            letter[c] = True
            low = s.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    starts = np.array([c for c, _ in SCRIPTS])
    names = np.array([NAMES.index(s) for _, s in SCRIPTS], np.int16)
    return lower, letter, names[np.maximum(np.searchsorted(starts, np.arange(_TOP), "right") - 1, 0)]


_cached: list = []


def tables():
    if not _cached:
        _cached.append(_tables())
    return _cached[0]


def points(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk and the document of each."""
    text = chunk.body.decode("utf-8", "replace")
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.int32)
    head = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    begins = np.searchsorted(head, np.append(chunk.starts, len(chunk.data)))
    return code, begins


def letter_words(code: np.ndarray):
    """Maximal runs of letters: start and end."""
    letter = tables()[1][code]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if len(letter) and letter[0]:
        edge = np.concatenate([[0], edge])
    if len(letter) and letter[-1]:
        edge = np.append(edge, len(letter))
    return edge[0::2], edge[1::2]


@dataclass
class Model:
    languages: list
    grams: np.ndarray  # the trigrams of training, ascending
    scores: np.ndarray  # trigram -> float32 per language; the last row is for all others
    scripts: np.ndarray  # script -> bool per language


class Distinct:
    """The distinct lower-cased words of a text: their letters, bounds, and which one each word is."""

    def __init__(self, code: np.ndarray, start: np.ndarray, end: np.ndarray):
        lower, letter, _ = tables()
        flat = lower[code[letter[code]]]
        ends = 4 * np.concatenate([[0], np.cumsum(end - start)])
        column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).dictionary_encode()
        _, cuts, raw = column.dictionary.buffers()
        self.cut = np.frombuffer(cuts, np.int64, len(column.dictionary) + 1) // 4
        self.flat = np.frombuffer(raw or b"", np.int32, int(self.cut[-1]))
        self.which = column.indices.to_numpy()

    def grams(self) -> np.ndarray:
        """The trigram centred on each letter, as one number; a word's ends read as 0."""
        before, after = np.zeros((2, len(self.flat)), np.int64)
        before[1:], after[:-1] = self.flat[:-1], self.flat[1:]
        before[self.cut[:-1]] = 0
        after[self.cut[1:] - 1] = 0
        return (before << 42) | (self.flat.astype(np.int64) << 21) | after

    def scores(self, model: Model) -> np.ndarray:
        """Per distinct word and language."""
        gram, which = np.unique(self.grams(), return_inverse=True)
        at = np.searchsorted(model.grams, gram)
        at[np.append(model.grams, -1)[at] != gram] = len(model.grams)
        out = np.add.reduceat(model.scores[at][which], self.cut[:-1], axis=0)
        allowed = model.scripts[tables()[2][self.flat[self.cut[:-1]]]]
        known = allowed.any(1)
        out[known[:, None] & ~allowed] -= 20
        out[~known] = 0
        return out


def fit(docs: DataFrame, folds: int = 4, held_out_fold: int = 2, max_docs: int = 4000,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn letter trigrams by language from a bounded sample of labelled documents.

    ``max_docs`` documents are drawn by a hash of their id and read whole.
    """
    one = docs.select(docs[id_col].cast("string").alias("i"), docs[text_col].cast("string").alias("t"),
                      docs[lang_col].cast("string").alias("l")).where("i is not null and t is not null and l is not null")
    one = one.where(F.crc32(F.col("i").cast("binary")) % folds != held_out_fold)
    # ids first: the sample's texts are fetched by a join with a bounded list
    ids = [r.i for r in one.select("i", F.xxhash64("i").alias("h")).orderBy("h", "i").limit(max_docs).collect()]
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in sorted(set(ids))], "i string"))
    rows = C.written(one.join(chosen, "i").select("l", "t"))

    def count(batches):
        """Of each document its trigrams, and as negative numbers its scripts."""
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code = np.frombuffer(text.encode("utf-32-le", "replace"), np.int32)
                words = Distinct(code, *letter_words(code))
                if not len(words.which):
                    continue
                often = np.repeat(np.bincount(words.which), np.diff(words.cut))
                keys, of = np.unique(np.concatenate([words.grams(), -1 - tables()[2][words.flat].astype(np.int64)]), return_inverse=True)
                times = np.bincount(of, np.concatenate([often, often])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(times)],
                                                 names=["l", "gram", "n"])

    # as many rows as the sample has trigrams
    counts = rows.mapInArrow(count, "l string, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counts["l"]))
    lang = np.searchsorted(np.array(languages, object), counts["l"].to_numpy(object)) if languages else np.zeros(0, np.int64)
    gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    grams, of = np.unique(gram[gram >= 0], return_inverse=True)
    table = np.zeros((len(grams) + 1, len(languages)))
    scripts = np.zeros((len(NAMES), len(languages)))
    table[of, lang[gram >= 0]] = n[gram >= 0]
    scripts[-1 - gram[gram < 0], lang[gram < 0]] = n[gram < 0]
    if languages:
        log = np.log((table + 0.1) / (table.sum(0) + 0.1 * (len(grams) + 1)))
        log[-1] = 0
        log -= log.mean(1, keepdims=True)
        table = np.clip(log, -6, 6)
        scripts = scripts / np.maximum(scripts.sum(0), 1) >= 0.01
    return Model(languages, grams, table.astype(np.float32), scripts.astype(bool))


def viterbi(scores: np.ndarray, cut: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row; ``cut`` bounds the sequences.  Runs all sequences in step, longest first."""
    n, k = scores.shape
    length = np.diff(cut)
    order = np.argsort(-length, kind="stable")
    begin, size = cut[:-1][order], length[order]
    back = np.empty((n, k), np.int16)
    best = np.zeros((len(order), k))
    live = int((size > 0).sum())
    ends = np.zeros((len(order), k))
    for t in range(int(size[0]) if len(size) else 0):
        while live and size[live - 1] <= t:
            live -= 1
        at = begin[:live] + t
        if t == 0:
            best[:live] = scores[at]
            back[at] = np.arange(k)
        else:
            old = best[:live]
            top = old.argmax(1)
            jump = old[np.arange(live), top] - penalty
            stay = old >= jump[:, None]
            back[at] = np.where(stay, np.arange(k), top[:, None])
            best[:live] = np.where(stay, old, jump[:, None]) + scores[at]
        ends[:live] = best[:live]
    out = np.zeros(n, np.int16)
    state = ends.argmax(1)
    live = 0
    for t in range((int(size[0]) if len(size) else 0) - 1, -1, -1):
        while live < len(size) and size[live] > t:
            live += 1
        at = begin[:live] + t
        out[at] = state[:live]
        state[:live] = back[at, state[:live]]
    return out


def word_labels(scores: np.ndarray, cut: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi labels, with a constant label where no other can gain."""
    n, k = scores.shape
    doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    run = np.concatenate([np.zeros((1, k)), np.cumsum(scores, axis=0, dtype=np.float64)])
    best = (run[cut[1:]] - run[cut[:-1]]).argmax(1)
    out = best[doc].astype(np.int16)
    gain = np.cumsum(scores - scores[np.arange(n), best[doc]][:, None], axis=0, dtype=np.float64)
    # largest gain of a run inside each document: a step per document keeps running minima apart
    width = 2 * (np.abs(gain).max() + 1) if n else 1.0
    low = np.concatenate([np.zeros((1, k)), gain])[:-1]
    floor = np.minimum.accumulate(low - doc[:, None] * width, axis=0) + doc[:, None] * width if n else low
    open_doc = np.zeros(len(cut) - 1, bool)
    open_doc[doc[((gain - floor) > penalty / 2).any(1)]] = True
    if open_doc.any():
        size = np.diff(cut)[open_doc]
        rows = np.flatnonzero(open_doc[doc])
        out[rows] = viterbi(scores[rows], np.concatenate([[0], np.cumsum(size)]), penalty)
    return out


def _labels(scores: np.ndarray, which: np.ndarray, cut: np.ndarray, penalty: float, cells: int = 4_000_000) -> np.ndarray:
    """``word_labels`` for the words ``which``, some documents at a time, so that scores of many languages stay small."""
    out, at = np.zeros(len(which), np.int16), 0
    while at < len(cut) - 1:
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + cells // scores.shape[1], "right")) - 1)
        out[cut[at]:cut[to]] = word_labels(scores[which[cut[at]:cut[to]]], cut[at:to + 1] - cut[at], penalty)
        at = to
    return out


def spans(docs: DataFrame, model: Model, penalty: float = 12.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and its spans (language, first letter, letters, words), in order."""

    return _run(docs, model, penalty, id_col, text_col)


def _run(docs, model, penalty, id_col, text_col):
    schema = "doc_id long, spans array<struct<lang:string,start:long,letters:long,words:long>>"
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("letters", pa.int64()), ("words", pa.int64())]))

    def run(batches):
        names = np.array(model.languages, object)
        for chunk, _ in C.pieces(batches):
            code, begins = points(chunk)
            start, end = letter_words(code)
            first = np.searchsorted(start, begins)
            if len(names) == 0 or not len(start):
                ends = np.zeros(len(begins), np.int32)
                empty = pa.array([], kind.value_type)
                yield pa.RecordBatch.from_arrays([chunk.ids_column(), pa.ListArray.from_arrays(pa.array(ends), empty)], names=["doc_id", "spans"])
                continue
            size = end - start
            words = Distinct(code, start, end)
            label = _labels(words.scores(model), words.which, first, penalty)
            doc = np.repeat(np.arange(len(begins) - 1), np.diff(first))
            new = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]))
            letters = np.add.reduceat(size, new)
            words = np.diff(np.append(new, len(start)))
            per_doc = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(begins) - 1))]).astype(np.int32)
            fields = [pa.array(names[label[new]], pa.string()), pa.array(start[new] - begins[doc[new]], pa.int64()),
                      pa.array(letters, pa.int64()), pa.array(words, pa.int64())]
            values = pa.StructArray.from_arrays(fields, names=["lang", "start", "letters", "words"])
            yield pa.RecordBatch.from_arrays([chunk.ids_column(), pa.ListArray.from_arrays(pa.array(per_doc), values)], names=["doc_id", "spans"])

    narrow = docs.select(docs[id_col].cast("long").alias("a"), docs[text_col].cast("string").alias("b"))
    return narrow.mapInArrow(run, schema)


def label(docs: DataFrame, model: Model, penalty: float = 12.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred (most letters), score (its share of letters) and spans."""
    found = spans(docs, model, penalty, id_col, text_col)
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.letters)
    per = F.transform(F.array_sort(F.array_distinct(F.col("spans.lang"))), lambda name: F.struct(
        F.aggregate(F.filter("spans", lambda s: s.lang == name), F.lit(0).cast("long"), lambda a, s: a + s.letters).alias("letters"),
        name.alias("lang")))
    top = F.aggregate(per, F.struct(F.lit(0).cast("long").alias("letters"), F.lit("und").alias("lang")),
                      lambda a, s: F.when(s.letters > a.letters, s).otherwise(a))
    return (found.withColumn("top", top).select(
        "doc_id", F.col("top.lang").alias("lang_pred"),
        F.when(total > 0, F.col("top.letters") / total).otherwise(0.0).alias("score"), "spans"))
