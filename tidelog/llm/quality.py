"""Quality by weak supervision: rules vote or abstain, EM weighs the votes.

Each rule looks at a few counts of a document and votes good (2), bad (1) or
abstains (0).  Documents with equal votes are counted together, a table of at
most 3^rules rows, and EM on it estimates how often each rule is right, wrong
or silent for good and for bad documents (a naive Bayes mixture).  A document's
posterior probability of being good replaces a rule that all must pass.

Defined results: a null or empty text has no words, all counts are 0 and the
base rules reject it; a null doc_id comes back null; rows are never merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .langid import points, tables

FEATURES = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "n_lines long, n_upper long, n_letters long, n_distinct long, n_stop long")
#: Frequent function words of the languages in view.
STOP_WORDS = ("the of and to in a is that for it with as was on be by at this from or an are which not "
              "der die und das den von zu mit ist im des dem auf ein eine nicht für sich als auch es "
              "le la les de des et en un une du que est pour dans qui par sur pas au plus "
              "el los las y del que se por con una para su al lo como más").split()


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode())] = 1
    return out


_SYMBOLS = _flags("#*$%&|<>")
_START = np.ones(256, np.int64)
_START[128:192] = 0
_START[[9, 10, 11, 12, 13, 32]] = 0


def _repeated_lines(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of ``FEATURES`` for each document."""

    def run(batches):
        stop = np.sort(C.Chunk.of([" ".join(STOP_WORDS).encode()]).words(lower=True).name)
        for chunk, _ in C.pieces(batches):
            words = chunk.words()
            h, first = words.name, words.first
            low = chunk.words(lower=True).name
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            salt = C.mix(np.arange(1, len(n) + 1, dtype=np.uint64))
            grams = C.windows(h, 3)
            inside = np.arange(len(grams)) + 3 <= first[doc[:len(grams)] + 1] if len(grams) else np.zeros(0, bool)
            start = np.flatnonzero(inside)
            _, which, times = np.unique(C.mix(grams[start] ^ salt[doc[start]]), return_inverse=True, return_counts=True)
            again = start[times[which] > 1]
            cover = np.zeros(len(h), bool)
            for k in range(3):
                cover[again + k] = True
            _, places = np.unique(C.mix(h ^ salt[doc]), return_index=True)
            total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[np.append(chunk.starts, len(chunk.data))])
            code, begins = points(chunk)
            lower, letter, _ = tables()
            count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[begins])
            lines = np.array([_repeated_lines(chunk.text(i)) for i in range(len(n))], np.int64).reshape(len(n), 2)
            at = np.minimum(np.searchsorted(stop, low), len(stop) - 1)
            columns = [n, total(_START[chunk.data]), total(_SYMBOLS[chunk.data]), lines[:, 1],
                       np.bincount(doc[cover], minlength=len(n)), lines[:, 0], count(letter[code] & (lower[code] != code)),
                       count(letter[code]), np.bincount(doc[places], minlength=len(n)),
                       np.bincount(doc[stop[at] == low], minlength=len(n))]
            yield pa.RecordBatch.from_arrays([chunk.ids_column(), *(pa.array(c, pa.int64()) for c in columns)],
                                             names=[x.split()[0] for x in FEATURES.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("a"), docs[text_col].cast("string").alias("b")).mapInArrow(run, FEATURES)


def _vote(bad, good):
    return F.when(bad, 1).when(good, 2).otherwise(0)


def rules() -> dict:
    """Name -> vote: 2 good, 1 bad, 0 abstain."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    ratio = lambda c, d=words: F.col(c) / d
    letters = F.greatest(F.col("n_letters"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "length": _vote(F.col("n_words") < 50, F.col("n_words") >= 100),
        "word_size": _vote((ratio("word_chars") < 2.5) | (ratio("word_chars") > 11), ratio("word_chars").between(3.5, 8)),
        "symbols": _vote(ratio("n_symbols") > 0.1, ratio("n_symbols") < 0.02),
        "lines": _vote(ratio("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))) > 0.3, F.col("n_dup_lines") == 0),
        "repeats": _vote(ratio("n_repeat_words") > 0.3, ratio("n_repeat_words") < 0.1),
        "capitals": _vote(ratio("n_upper", letters) > 0.3, ratio("n_upper", letters) < 0.1),
        "letters": _vote(ratio("n_letters", chars) < 0.7, ratio("n_letters", chars) > 0.9),
        "stop_words": _vote(ratio("n_stop") < 0.05, ratio("n_stop") > 0.15),
        "variety": _vote((ratio("n_distinct") < 0.2) & (F.col("n_words") < 5000), ratio("n_distinct") > 0.3),
    }


#: Vote probabilities (abstain, bad, good) that every rule is presumed to have, for bad and good documents.
PRIOR = ((0.3, 0.5, 0.2), (0.195, 0.005, 0.8))


def label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, strength: float = 0.3, presume: tuple = PRIOR):
    """EM over distinct vote rows with counts: posterior of good per row, and the vote table [class, rule, vote].

    The presumed vote probabilities weigh as much as ``strength`` times the
    documents (a Dirichlet prior): without it EM would fit its two classes to the
    largest kind of bad document and call the other kinds good.
    """
    n_rules = votes.shape[1]
    presumed = np.repeat(np.array(presume)[:, None], n_rules, 1)
    table, prior = presumed.copy(), np.array([0.3, 0.7])
    hot = np.eye(3)[votes]  # row, rule, vote
    weight = strength * counts.sum() * prior[:, None, None] + 1
    for _ in range(rounds):
        log = np.log(prior) + np.einsum("rkv,ckv->rc", hot, np.log(table))
        log -= log.max(1, keepdims=True)
        post = np.exp(log) / np.exp(log).sum(1, keepdims=True)
        mass = post * counts[:, None]
        prior = (mass.sum(0) + 1) / (counts.sum() + 2)
        got = np.einsum("rc,rkv->ckv", mass, hot) + presumed * weight
        table = got / got.sum(2, keepdims=True)
    return post[:, 1], table


def judge(docs: DataFrame, threshold: float = 0.5, strength: float = 0.3, presume: tuple = PRIOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All features with base_failed, votes, quality (posterior of good) and kept."""
    spark = docs.sparkSession
    votes = rules()
    table = C.written(features(docs, id_col, text_col).select("*", F.concat(*(v.cast("string") for v in votes.values())).alias("votes")))
    rows = table.groupBy("votes").count().collect()  # at most 3^rules
    if rows:
        patterns = [r["votes"] for r in rows]
        post, _ = label_model(np.array([list(map(int, p)) for p in patterns]), np.array([r["count"] for r in rows], float), strength=strength, presume=presume)
        told = list(zip(patterns, post.tolist()))
    else:
        told = []
    known = spark.createDataFrame(told, "votes string, quality double")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (table.join(F.broadcast(known), "votes", "left").withColumn("base_failed", base)
            .withColumn("kept", ~base & (F.col("quality") >= threshold)))
