"""The registered queries: each applies one operator to its whole table and derives the columns that
are compared."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import (
    collision_dedup,
    decontaminate,
    hpylm,
    html_extract,
    langid,
    lexical_search,
    quality,
    sentencepiece_codec,
    simhash,
    spelling,
    suffix_dedup,
    token_files,
    warc,
)
from leadloom.llm.common import table

# The folder of public tokenizer files; a parameter of the operators, never copied.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
BYTE_RANKS = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
BYTE_END = 50256  # fixed value: the id of that vocabulary which is free for the end of a document


def byte_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model learns from all documents but those of one seventh, told by their ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    return hpylm.score(docs, fold != 2)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digests(suffix_dedup.removed_bytes(docs))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op4_collision_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return collision_dedup.near_duplicates(vectors, min_cosine=0.9)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.digests(sentencepiece_codec.encode_texts(docs, PIECE_MODEL))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return (
        warc.archive_round_trip(pages)
        .where("last")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, words_to_shingle=3, max_bits=2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: their source is the host, their language column a declaration."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = langid.identify(
        docs, langid.fit(docs), host=F.col("source"), declared=F.col("lang")
    )
    return found.select("doc_id", "lang", "language", "confidence", "accepted")


def op8_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, by a model fitted on documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", langid.markup_language(F.col("html")).alias("declared"),
        langid.markup_text(F.col("html")).alias("shown"),
    )
    url = F.col("url")
    found = langid.identify(
        pages, langid.fit(docs), "shown", langid.url_host(url), langid.url_suffix(url),
        F.col("declared"),
    )
    return found.select("page_id", "url", "declared", "language", "confidence", "accepted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.count_tokens(docs, BYTE_RANKS, byte_pattern(), BYTE_END)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, one run in 97 with a letter left out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_variants(docs, one_in=97).select(
        "word", "form", "root", "n", "n_near", "form_n"
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.search(docs, table(spark, sf_dir, "benchmark"), top=20)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model learns from labelled documents but those of one fourth, told by their ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(quality.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_pitman_yor, op2_suffix_dedup, op3_html_extraction, op4_collision_dedup,
        op5_sentencepiece, op6_warc, op7_simhash, op8_language_id, op8_language_id_pages,
        op9_decontamination, op10_token_counts, op11_spelling_variants,
        op12_lexical_search, op13_quality_classifier,
    )
}

# Ranked search as one statement: postings of all terms, statistics, scores, rank.
SEARCH_SQL = r"""
WITH lowered AS (
    SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
), tokens AS (
    SELECT doc_id, unnest(regexp_extract_all(
        t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM lowered WHERE t IS NOT NULL
), postings AS (
    SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term
), sizes AS (
    SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id
), totals AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes
), weights AS (
    SELECT term, CAST(floor(1000 * ln(
        CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM postings, totals GROUP BY term, docs
), wanted AS (
    SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL
), repeats AS (
    SELECT item_id, term, count(*) AS times FROM wanted GROUP BY item_id, term
), scores AS (
    SELECT item_id, doc_id, CAST(sum(
        times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))
    ) AS BIGINT) AS score
    FROM repeats JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals
    GROUP BY item_id, doc_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER)
        AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

ORACLES: dict[str, str] = {"op12_lexical_search": SEARCH_SQL}
