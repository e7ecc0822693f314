"""Suffix arrays, exact substring removal, word-window removal and BPE."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import bpe, common, exact, jaccard, substring, suffix

DOCS = "doc_id long, text string, key string, bucket int"


def docs_of(spark, rows):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "k", 1) for r in rows], DOCS).repartition(3)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_suffix_array_and_prefixes(letters):
    rng = random.Random(letters)
    for _ in range(40):
        pieces = [bytes(rng.choice(b"abcde"[:letters]) for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(1, 7))]
        pieces += pieces[:rng.randint(0, 2)]
        text = b"\xff".join(pieces) + b"\xff\xfe"
        t = np.frombuffer(text, np.uint8) + np.uint8(2)
        sa, b = suffix.suffix_array(t), t.tobytes()
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        prefix, before = suffix.permuted_prefixes(t, sa)
        for x, y in zip(sa[1:].tolist(), sa[:-1].tolist()):
            n = 0
            while max(x, y) + n < len(b) and b[x + n] == b[y + n]:
                n += 1
            assert (prefix[x], before[x]) == (n, y)
        for length in (1, 4):
            count = Counter(p[i:i + length] for p in pieces for i in range(len(p) - length + 1))
            want = [[count[p[i:i + length]] > 1 for i in range(len(p) - length + 1)] for p in pieces]
            assert [x.tolist() for x in suffix.repeated(pieces, length)] == want


def cut_bytes(rows, length):
    count, out = Counter(), []
    texts = [(t or "").encode() for _, t in rows]
    for b in texts:
        count.update(b[i:i + length] for i in range(len(b) - length + 1))
    for (i, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def passages(rng, n=50):
    base = "".join(rng.choice("abé d") for _ in range(400))
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(30))
    rows = [(1, None), (2, ""), (2, ""), (None, "short"), (3, "x" * 90), (4, "x" * 700)]
    for i in range(n):
        a, b = sorted(rng.sample(range(400), 2))
        rows.append((None if i % 13 == 0 else i, noise() + base[a:b] + noise()))
    return rows + rows[10:13]


@pytest.mark.parametrize("length,hot", [(20, 4096), (20, 3), (20, 10), (20, 1), (7, 2), (1, 4096), (20, 2048)])
def test_exact_removal(spark, length, hot):
    rows = passages(random.Random(length))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = [(*tuple(r)[:4], bytes(r.kept)) for r in exact.remove_repeats(docs_of(spark, rows), length, hot).collect()]
    assert sorted(got, key=key) == sorted(cut_bytes(rows, length), key=key)


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert exact.remove_repeats(none).count() == 0 and substring.remove_repeats(none).count() == 0


def cut_words(rows, width):
    """The window rule over rows with distinct ids."""
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    for i, t in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(words) - width + 1):
            w = tuple(words[k:k + width])
            if w in seen:
                gone.update(range(k, k + width))
            seen.setdefault(w, (i, k))
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


@pytest.mark.parametrize("width", [3, 8, 20])
def test_word_windows(spark, width):
    rng = random.Random(width)
    base = [rng.choice(["un", "deux", "trois", "été"]) for _ in range(300)]
    rows = [(None, " ".join(base[:60])), (0, None), (1, ""), (2, " \t\n "), (3, "a " * 500), (4, "a\x0bb c d")]
    for i in range(5, 60):
        a, b = sorted(rng.sample(range(300), 2))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join([f"x{i}", *base[a:b], f"y{i}"])))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs_of(spark, rows), width=width).collect()}
    assert got == cut_words(rows, width)


def test_unlike_windows_stay(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(k + 1, " ".join(["".join("ab"[b ^ k] for b in bits), *(f"w{i}" for i in range(19))])) for k in (0, 1)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs_of(spark, rows), width=20).collect()}
    assert got == {1: (20, 0), 2: (20, 0)}


def test_equal_rows_keep_one_and_layout_stays(spark):
    text = "one  two\nthree " + " ".join(f"w{i}" for i in range(40))
    got = substring.remove_repeats(docs_of(spark, [(7, text)] * 3 + [(8, "alone\n here")]), width=20, layout=True, carry=("key", "bucket")).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 43, 43]
    assert sum(r.kept_text == text for r in got) == 1 and "alone\n here" in [r.kept_text for r in got]
    assert {(r.key, r.bucket) for r in got} == {("k", 1)}


def test_texts_longer_than_a_chunk(spark):
    words = [f"w{i}" for i in range(400_000)]
    one, two = " ".join(words), " ".join([*words[:1000], "changed", *words[1001:]])
    assert len(one) > common.CHUNK_BYTES
    rows = [(1, one), (2, two), (3, "short")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs_of(spark, rows), width=20).collect()}
    assert got == cut_words(rows, 20)
    cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in exact.remove_repeats(docs_of(spark, rows)).collect()}
    at = one.index("w1000 ")
    n = len(one.encode())
    # all but the changed word, and the bytes around it that no repeated string reaches
    assert cut[1] == (n, n - len("w1000"), 2) and cut[2] == (len(two), len(two) - len("changed"), 2) and cut[3] == (5, 0, 0) and at > 200
    same = {r.doc_id: r.component_id for r in jaccard.join(docs_of(spark, rows), n=3, percent=90).collect()}
    assert same == {1: 1, 2: 1, 3: 3}


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(5)
    texts = [None, "", " ", "a", "  two  spaces \n\n tab\t", "naïve Straße 日本語 🙂👩‍🚀", "x" * 3000, "<|endoftext|> and <|endoftext|>", "it's they'll I'D",
             "   ​ wide", "1234567 ٣٤", "é combining", "aaaa" * 40 + "!" * 99, "\x00\x01\x7f", " \r\n \x85 "]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 1500), rng.randint(0x4e00, 0x4fff)])) for _ in range(rng.randint(1, 90))) for _ in range(120)]
    got = bpe.encode(docs_of(spark, list(enumerate(texts))), path).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want, repr(texts[r.doc_id])
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs_of(spark, [(None, "x"), (1, "x"), (1, "x")]), path).count() == 3
    assert json.load(open(path))["model"]["type"] == "BPE" and hashlib.sha256(b"").hexdigest()


def test_bpe_one_word_step_by_step():
    """The arrays merge like the rule itself: lowest rank first, leftmost on ties."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    spec, vocab = json.load(open(path))["model"], bpe.vocabulary(path)
    ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["merges"])}
    letters = {v: k for k, v in bpe._printable().items()}
    for word in ("antidisestablishment", " thereafter", "zzzzzzzz", "Donaudampfschifffahrt" * 4):
        parts = [letters[b] for b in word.encode()]
        while True:
            pairs = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        want = [spec["vocab"][p] for p in parts]
        assert vocab._short([word.encode()]) == [want] and vocab._long(word.encode()) == want
