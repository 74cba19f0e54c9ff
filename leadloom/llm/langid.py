"""Language of a text from several kinds of evidence.

Byte trigrams give the likelihood of the text in each language.  What the corpus itself shows then
adds up by grouped sums of the text posteriors: how far the declared language can be trusted, which
languages an address suffix and a host carry.  The host's prior is smoothed towards that of its
suffix and this one towards all rows; a row's own text is taken out of its host's sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.text import quoted_name
from leadloom.llm.common import stored, text_buffer

BUCKETS = 1 << 14
# The classifier is fitted on so many labelled rows of each language, those of least hash.
SAMPLE_PER_LANGUAGE = 1000
# Overlapping trigrams are not independent: their log likelihood counts this much.
TRIGRAM_WEIGHT = 0.3
# Rows that the next wider group counts for when a narrower one is smoothed.
HOST_SMOOTHING = 20.0
SUFFIX_SMOOTHING = 20.0
DECLARED_SMOOTHING = 20.0
MIN_CONFIDENCE = 0.5
# Bytes of which trigrams are made at once.
STEP = 1 << 20

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def trigrams(raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of every byte trigram that begins in a text and has a letter, ASCII case and
    other bytes aside; behind a text stand spaces."""
    for at in range(0, len(raw), STEP):
        letters = _LETTER[raw[at : at + STEP + 2]].astype(np.uint32)
        n = min(STEP, len(raw) - at)
        letters = np.append(letters, np.full(n + 2 - len(letters), 0x20, np.uint32))
        place = np.arange(at, at + n)
        text = np.searchsorted(starts, place, "right") - 1
        end = starts[text + 1]
        a = letters[:n]
        b = np.where(place + 1 < end, letters[1 : n + 1], np.uint32(0x20))
        c = np.where(place + 2 < end, letters[2 : n + 2], np.uint32(0x20))
        shown = (a != 0x20) | (b != 0x20) | (c != 0x20)
        code = ((a << 16) | (b << 8) | c) * np.uint32(2654435761)
        yield (code[shown] >> np.uint32(18)).astype(np.int64), text[shown]


@dataclass
class TextModel:
    languages: list[str]
    log_likelihood: np.ndarray  # bucket x language


def fit(
    docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> TextModel:
    """A trigram model from at most `per_language` rows of each label, whole texts.  Rows without
    label or key are left out (rows of equal key and label count as one); without any labelled row there is no language."""
    order = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    # ids alone are ranked, and each task ranks its own first; per_language of a label are left
    picked = (
        docs.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, label)
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= per_language)
        .select(key, label).distinct()
    )
    sample = docs.select(key, label, text).join(F.broadcast(picked), [key, label]).select(
        F.col(label).alias("label"), F.col(text).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, labels = np.unique(batch.column(0).to_pylist(), return_inverse=True)
            counts = np.zeros(len(names) * BUCKETS, np.int64)
            for bucket, row in trigrams(*text_buffer(batch.column(1))):
                counts += np.bincount(labels[row] * BUCKETS + bucket, minlength=len(counts))
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "label": pa.array(names[found // BUCKETS].tolist(), pa.string()),
                "bucket": found % BUCKETS,
                "n": counts[found],
            })

    # at most languages x buckets rows come back
    rows = (
        sample.mapInArrow(run, "label string, bucket long, n long")
        .groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()
    )
    languages = sorted({r.label for r in rows})
    counts = np.zeros((BUCKETS, len(languages)))
    for r in rows:
        counts[r.bucket, languages.index(r.label)] = r.n
    counts += 0.5
    return TextModel(languages, np.log(counts / counts.sum(axis=0)))


def text_evidence(docs: DataFrame, model: TextModel, text: str) -> DataFrame:
    """`docs` with `_t0`, `_t1`, ... (log likelihood of the text in each language) and `_letters`
    (trigrams seen)."""
    shared = docs.sparkSession.sparkContext.broadcast(
        model.log_likelihood  # buckets x languages
    )
    count = len(model.languages)
    names = [*docs.columns, *(f"_t{i}" for i in range(count)), "_letters"]
    place = names.index(text)
    schema = T.StructType([
        *docs.schema.fields,
        *(T.StructField(f"_t{i}", T.DoubleType()) for i in range(count)),
        T.StructField("_letters", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value * TRIGRAM_WEIGHT
        for batch in batches:
            rows = batch.num_rows
            sums, seen = np.zeros((count, rows)), np.zeros(rows, np.int64)
            for bucket, row in trigrams(*text_buffer(batch.column(place))):
                seen += np.bincount(row, minlength=rows)
                for i in range(count):
                    sums[i] += np.bincount(row, table[bucket, i], rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, sums), pa.array(seen)], names
            )

    return docs.mapInArrow(run, schema)


def posterior(logs: list[Column]) -> list[Column]:
    """Shares that add up to 1."""
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts = [F.exp(x - top) for x in logs]
    total = reduce(lambda a, b: a + b, parts)
    return [p / total for p in parts]


def identify(
    docs: DataFrame,
    model: TextModel,
    text: str = "text",
    host: Column | None = None,
    suffix: Column | None = None,
    declared: Column | None = None,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """`docs` with `language`, `confidence` and `accepted`, replacing columns of these names.

    Missing evidence (null, or a column not given) counts as a group of its own.  A text without
    letters, empty or null has no language and is not accepted; nor is one whose best language is
    less sure than `min_confidence`.  Ties go to the language first in the alphabet.
    """
    docs = docs.drop("language", "confidence", "accepted")
    count, columns = len(model.languages), docs.columns
    if not count:
        return docs.withColumns({
            "language": F.lit(None).cast("string"),
            "confidence": F.lit(0.0), "accepted": F.lit(False),
        })
    each = range(count)
    given = {"_host": host, "_suffix": suffix, "_declared": declared}
    # the columns of `docs` are numbered, so none can clash with those added here
    numbered = docs.select(
        *(quoted_name(c).alias(f"c{i}") for i, c in enumerate(columns)),
        *((F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")).alias(name)
          for name, c in given.items()),
    )
    rows = text_evidence(numbered, model, f"c{columns.index(text)}")
    # a text without letters says nothing about its host
    shown = posterior([F.col(f"_t{i}") for i in each])
    own = [F.when(F.col("_letters") > 0, p).otherwise(0.0) for p in shown]
    rows = rows.withColumns({f"_p{i}": own[i] for i in each})
    narrow = rows.select("_host", "_suffix", "_declared", *(f"_p{i}" for i in each))
    cells = stored(
        narrow.groupBy("_host", "_suffix", "_declared").agg(
            *(F.sum(f"_p{i}").alias(f"s{i}") for i in each)
        ),
        "language-evidence",
    )

    def sums(by: str, letter: str) -> DataFrame:
        return cells.groupBy(*([by] if by else [])).agg(
            *(F.sum(f"s{i}").alias(f"{letter}{i}") for i in each)
        )

    overall = sums("", "a").first()
    total = sum(overall[f"a{i}"] or 0.0 for i in each)
    share = [((overall[f"a{i}"] or 0.0) + 1) / (total + count) for i in each]

    def all_of(letter: str) -> Column:
        return reduce(lambda a, b: a + b, (F.col(f"{letter}{i}") for i in each))

    suffixes = sums("_suffix", "x").select("_suffix", *(
        ((F.col(f"x{i}") + SUFFIX_SMOOTHING * share[i]) / (all_of("x") + SUFFIX_SMOOTHING))
        .alias(f"_x{i}") for i in each
    ))
    trust = sums("_declared", "d").select("_declared", *(
        ((F.col(f"d{i}") + DECLARED_SMOOTHING * share[i] * all_of("d") / max(total, 1e-9))
         / ((overall[f"a{i}"] or 0.0) + DECLARED_SMOOTHING * share[i])).alias(f"_d{i}")
        for i in each
    ))
    hosts = sums("_host", "_h")
    joined = (
        rows.join(stored(hosts, "language-hosts"), "_host")
        .join(stored(suffixes, "language-suffixes"), "_suffix")
        .join(stored(trust, "language-declared"), "_declared")
    )
    others = reduce(lambda a, b: a + b, (F.col(f"_h{i}") - F.col(f"_p{i}") for i in each))
    fused = [
        F.col(f"_t{i}")
        + F.log((F.greatest(F.col(f"_h{i}") - F.col(f"_p{i}"), F.lit(0.0))
                 + HOST_SMOOTHING * F.col(f"_x{i}"))
                / (F.greatest(others, F.lit(0.0)) + HOST_SMOOTHING))
        + F.log(F.greatest(F.col(f"_d{i}"), F.lit(1e-9)))
        for i in each
    ]
    names = F.array(*map(F.lit, model.languages))
    has_text = F.col("_letters") > 0
    # columns of their own, so that no expression holds another one many times
    weighed = (
        joined.withColumn("_logs", F.array(*fused))
        .withColumn("_top", F.array_max("_logs"))
        .withColumn("_all", F.aggregate(
            "_logs", F.lit(0.0), lambda sum_, x: sum_ + F.exp(x - F.col("_top"))
        ))
    )
    best = 1 / F.col("_all")
    place = F.array_position("_logs", F.col("_top")).cast("int")
    return weighed.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)),
        F.when(has_text, F.element_at(names, place)).alias("language"),
        F.when(has_text, best).otherwise(0.0).alias("confidence"),
        (has_text & (best >= min_confidence)).alias("accepted"),
    )


def url_host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1),
                            F.lit("")))


def url_suffix(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url_host(url), "([^.]+)$", 1), F.lit(""))


def markup_language(html: Column) -> Column:
    """The primary tag of the language that `<html lang>` declares."""
    found = F.regexp_extract(
        html, "(?is)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?\\s*([a-z]{2,3})\\b", 1
    )
    return F.lower(F.nullif(found, F.lit("")))


def markup_text(html: Column) -> Column:
    """What a page shows, roughly: scripts, styles and tags taken out."""
    hidden = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    return F.regexp_replace(hidden, "<[^>]*>", " ")
