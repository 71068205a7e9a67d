"""A training-data pipeline over `documents`: five curation operators, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again before the next. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm import compressor, mixing, ngramjoin, packing, pii
from typeloom.llm.common import discard, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    model = compressor.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compressor.score_documents(docs, model, carry=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The smallest doc_id of a group stays. Rows of one id with different texts are different
    documents; of those of one group, and of rows repeated with id and text, one stays. Documents
    without words, or without an id, all stay.
    """
    groups = ngramjoin.jaccard_classes(docs, n=5, p=80, q=100)
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("component_key"))
    gone = groups.where(~first).select("doc_id", "text_key").distinct()
    again = groups.where(first & (F.col("n_shingles") > 0)).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_key")
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    kept = keyed.join(gone, ["doc_id", "text_key"], "left_anti")
    if again.limit(1).count():
        once = kept.join(again, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
        kept = kept.join(again, ["doc_id", "text_key"], "left_anti").unionByName(once)
    return kept.select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one that a source's budget cuts is rounded to a whole.

    Documents are weighted by the compression classifier's score of the text as it is now. Documents
    without words cost no budget; each stays once.
    """
    model = compressor.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = mixing.mix(compressor.score_documents(docs, model, carry=COLUMNS), carry=("text", "lang", "source", "n_chars"), quality="score")
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(F.lit(1)).cast("int")
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times))).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: Learned models, hashing and a tokenizer: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
