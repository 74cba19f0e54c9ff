"""From raw documents to token ids, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next
one's documents.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import decontaminate, langid, sentencepiece_codec, simhash, suffix_dedup
from leadloom.llm.common import stored, table
from leadloom.llm.queries import PIECE_MODEL


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with confidence; texts without letters go.  The source
    serves as host, the language column as declaration."""
    found = langid.identify(
        docs, langid.fit(docs), host=F.col("source"), declared=F.col("lang")
    )
    return found.where("accepted").select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id in each group of near copies."""
    return simhash.keep_one(docs, words_to_shingle=3, max_bits=2).select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; every document stays, and `n_chars`
    follows its text."""
    cut = suffix_dedup.without_repeats(docs)
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.withColumn(
        "n_chars", F.when(F.col("text").isNotNull(), size).otherwise(F.col("n_chars"))
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark")).select(
        *docs.columns
    )


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, how many, and the text that the ids decode to."""
    return sentencepiece_codec.encode_texts(docs, PIECE_MODEL).withColumn(
        "n_tokens", F.size("ids").cast("long")
    )


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

# Fingerprints, passages and ids are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
