"""The corpus pipeline: stages over ``documents``, each calling one of the operators.

Every stage works on all rows that its predecessor kept.  All but the last
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.llm import language, pack, repeats, simhash
from fieldlake.llm.staging import stage

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the rows that have a language; documents that the model rejects go.

    Null and empty texts go, texts of any length are read whole, ties are rejected, equal
    rows share their fate, null ids are not fitted on, other columns pass, an empty table
    stays empty.  Without any labelled row no language is known and all documents go.
    """
    model = language.fit(docs.where(F.col("doc_id").isNotNull() & ~language.held_out()))
    return language.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays: three-word shingles, at most three differing bits.

    The smallest id stays, null ids last, of equal rows one.  Texts without words are a
    class like any other.  Columns may have any name; an empty table stays empty.
    """
    return simhash.keep_one(docs, shingle=3, max_distance=3)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes and more that an earlier document has are cut out of the texts.

    Every row stays; a null text becomes empty.  Rows of one id never cut each other,
    null ids stand last.  Columns may have any name; an empty table stays empty.
    """
    cut = repeats.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens along the curve.

    A null or empty text is its closing id alone; long texts are cut into pieces, repeated
    rows are packed each.  An empty table has no pieces.
    """
    return pack.pack(docs, VOCABULARY)


STAGES = [
    ("language", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # SQL expresses none of the stages; tests hold each against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
