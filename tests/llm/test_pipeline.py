"""Every stage of the pipeline on what the one before kept, against plain versions."""

import re

import corpus_pipeline
from tidelog.llm import common, toxicity

from .test_bytes import cut_words
from .test_joins import brute

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0]))


def test_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(common.written(stage(spark, steps[-1], SF)))
    for df in steps[:-1]:
        assert df.columns == docs.columns
    first, clean, single, cut, safe = map(rows_of, steps[:-1])

    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert clean == [r for r in first if score[r[0]] < 0.7]

    assert single == [r for r, (d, _, c) in zip(clean, brute(clean, 5, 80)) if d == c]

    want = cut_words(single, 20)
    assert cut == [(i, t if not want[i][1] else want[i][2]) for i, t in single]

    norm = lambda t: " ".join(re.findall(r"\S+", t.lower()))
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert safe == [(i, t) for i, t in cut if not any(x in norm(t) for x in items)]

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in steps[-1].collect()}
    assert len(got) == len(safe)
    for i, t in safe:
        assert got[i].ids == library.encode(t, add_special_tokens=False).ids and got[i].n_tokens == len(got[i].ids) and got[i].text == t


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF))
    key = lambda r: (r.doc_id, r.n_tokens, tuple(r.ids))
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, docs.collect()))


def test_odd_rows_and_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, item_id int, label string"
    rows = [(1, None, "en", "s", None, 1, "a"), (2, "", None, None, 0, 2, "b"), (None, "a lonely line", "en", "s", 13, 3, None),
            (3, "x " * 30_000, "en", "s", 60_000, 4, "c"), (4, "twice the same", "en", "s", 14, 5, "d"), (4, "twice the same", "en", "s", 14, 5, "d")]
    for own in (rows, []):
        docs = spark.createDataFrame(own, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = common.written(stage(spark, docs, SF))
            assert k == 4 or docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert sorted(str(r.doc_id) for r in docs.collect()) == (["1", "2", "3", "4", "None"] if own else [])
