"""From raw documents to token ids: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, common, decontam, jaccard, substring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7, learned from the labels outside one fold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=3, held_out_fold=1)
    return toxicity.clean(docs, model, threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (smallest doc_id) of each group linked by five-word shingles with a Jaccard index of 0.8 or more."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    return jaccard.Join(docs, n=5, percent=80, carry=rest).kept().select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that start earlier too; n_chars follows."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = substring.remove_repeats(docs, width=20, carry=rest, layout=True).withColumnRenamed("kept_text", "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids and the text decoded from them."""
    import public_tokenizers

    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: Learned models and iterated joins have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
