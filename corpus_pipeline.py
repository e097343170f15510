"""From raw documents to packed sequences.

Each stage works on all rows of the one before, returns the columns of ``documents`` (the last one: pieces of
sequences), and is written as Parquet and read again before the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlog.llm import cluster, langid, minhash, mixing, packing, rows, suffix
from stmtlog.plans.stage import stage

WEIGHTS, MOST, LENGTH, CAPACITY = (1, 2, 3), 3, 200, 2048


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The number of a row, for stages that read their documents twice.
ROW = "__number"


def _documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents; any others are left behind, so their names can't clash with those made here."""
    cluster.ship(spark)
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and texts without letters go.

    A null lang becomes the one found.  A text with none of the n-grams of any language, such as a single letter, says
    nothing about its language: it stays with the lang it has, which may be null.  A corpus without any labelled text
    is left as it is, as nothing can be learned.
    """
    docs = _documents(spark, docs)
    filters = langid.fit(docs)
    if not filters.languages:
        return docs
    found = langid.identify(docs, filters).filter("lang_pred <> 'und'")
    lang = F.coalesce("lang", F.when(F.col("score") > 0, F.col("lang_pred")))
    return found.withColumn("lang", lang).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    cluster.ship(spark)
    docs = rows.numbered(docs, "numbered", ROW, *COLUMNS)
    return minhash.one_of_each(docs, minhash.near_duplicates(docs, percent=80, row=ROW), row=ROW)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of 200 bytes and more that occur twice."""
    docs = _documents(spark, docs)
    cut = suffix.cut(suffix.with_spans(docs, length=LENGTH))
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that bring the sources to their weights, shard by shard."""
    cluster.ship(spark)
    docs = rows.numbered(docs, "numbered", ROW, *COLUMNS)
    return mixing.take(docs, mixing.mix(docs, weights=WEIGHTS, most=MOST, row=ROW), row=ROW)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of at most 2048 tokens."""
    docs = _documents(spark, docs)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=CAPACITY)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: Sketches, hashed draws and tokenizers have no counterpart in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
