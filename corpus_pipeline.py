"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows its predecessor kept and returns the columns of documents; the last returns packed pieces.

1. Language: documents without a letter or without a clear language go.
2. Near duplicates: of each group of linked documents the one with the least id stays; of rows with that id and different
   or equal texts one stays. Documents with a null id form groups like any other.
3. Repeated passages: bytes covered by a 100-byte string that starts earlier go; a document with no word left goes.
4. Mix: each source gives the words of its target, whole epochs first; the document on the edge is cut after its last word.
5. Packing into sequences of at most 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.llm import common, jaccard, language_id, mixing, packing, suffix_dedup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return language_id.accepted(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return jaccard.one_of_each(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return suffix_dedup.without_repeats(docs).filter(F.col("text").rlike(common.WORD))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("suffix_array_dedup", remove_repeats),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The first stage is a trained network, so SQL has no equivalent; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
