"""A corpus pipeline of five stages over the operators of ``logsift.llm``.

Every stage reads all that the one before kept and returns the columns of documents, but for the last, which
returns the places of the packed pieces. Between stages the rows are written to the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import exact_dedup, hyperminhash, language, mixing, packing
from logsift.llm.shipping import ship
from logsift.session import configure, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without letters and rejected ones go."""
    ship(configure(spark))
    model = language.train(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return language.predict(docs, model).where("not __lang.rejected").select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space runs count as one blank): that with the smallest doc_id."""
    ship(configure(spark))
    return exact_dedup.unique_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity 0.8: that with the smallest doc_id.

    Rows of one id with several texts are judged each by its own text. Rows with a null id, without text or without words are linked with
    nothing and stay; repeated rows agree. An empty table stays empty, and columns of any name pass.
    """
    ship(configure(spark))
    gone = hyperminhash.near_duplicates(docs, words=5).where("not stays").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    left, right = docs.alias("kept"), gone.alias("gone")
    same = (F.col("kept.doc_id") == F.col("gone.gone_id")) & (F.xxhash64("kept.text") == F.col("gone.gone_hash"))
    return left.join(right, same, "left_anti").select("kept.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out or repeated, whole."""
    ship(configure(spark))
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    ship(configure(spark))
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Hash signatures, learned models and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
