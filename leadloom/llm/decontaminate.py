"""Test items inside documents: MinHash containment search by size classes, then an exact count.

Items are partitioned by their number of shingles.  For each class, documents are looked at through
overlapping windows about as long as the items, since a sketch of a whole long document would drown
a short item.  A window's sketch is the least hash in each of its bins; an item whose sketch shares
a value with a window's is a candidate.  Candidates are counted exactly, shingle by shingle.

Only shingles that may occur in an item bear on containment, so all others are dropped by a bit set
of fixed size before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import (
    PUNCTUATION,
    blocks_of,
    mix,
    stored,
    word_hashes,
    words_of,
)

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
# Bins of a sketch for each shingle of the class's largest item.
BINS_PER_SHINGLE = 16
# Size of the bit set: fixed, whatever the number of items.
FILTER_BITS = 1 << 24
# Text that is looked at at once.
STEP_BYTES = 2 << 20
# Odd numbers that tell the places of words in a shingle apart.
_ODD = mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


def shingles(
    raw: np.ndarray, starts: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of all texts: hash, text, place in the text, first and last byte.  A text of
    fewer words is one shingle."""
    begins, ends, first = words_of(raw, starts, PUNCTUATION)
    hashes = word_hashes(raw, begins, ends)
    sizes = np.diff(first)
    counts = np.where(sizes == 0, 0, np.maximum(sizes - width + 1, 1))
    text = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    head = first[text] + place
    words = np.minimum(width, sizes)[text]
    summed = words.astype(np.uint64)
    for j in range(width):
        there = j < words
        at = np.minimum(head + j, max(len(hashes) - 1, 0))
        summed = summed + np.where(there, hashes[at] * _ODD[j], np.uint64(0))
    return mix(summed), text, place, begins[head], ends[head + words - 1]


# punctuation read as space
_SPACED = bytes(0x20 if PUNCTUATION[b] else b for b in range(256))


def shingle_rows(
    texts: DataFrame, key: str, text: str, width: int, wanted: np.ndarray | None
) -> DataFrame:
    """`key`, `place`, `hash`, `shingle` (its words) of the shingles that pass the bit set."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)  # FILTER_BITS, or nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch, raw, starts in blocks_of(batches, 1, STEP_BYTES):
            hashes, row, place, begin, end = shingles(raw, starts, width)
            if bits is not None:
                spot = hashes % np.uint64(FILTER_BITS)
                kept = np.flatnonzero(
                    (bits[(spot >> np.uint64(3)).astype(np.int64)]
                     >> (spot & np.uint64(7)).astype(np.uint8)) & 1
                )
            else:
                kept = np.arange(len(hashes))
            keys = batch.column(0)
            for at in range(0, len(kept), 1 << 14):
                part = kept[at : at + (1 << 14)]
                words = [
                    b" ".join(raw[begin[i] : end[i]].tobytes().translate(_SPACED).split())
                    for i in part
                ]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row[part])), pa.array(place[part]),
                     pa.array(hashes[part].view(np.int64)), pa.array(words, pa.binary()).cast(pa.string())],
                    ["key", "place", "hash", "shingle"],
                )

    return texts.select(F.col(key).alias("key"), F.lower(text).alias("text")).mapInArrow(
        run, T.StructType([
            T.StructField("key", texts.schema[key].dataType),
            T.StructField("place", T.LongType()), T.StructField("hash", T.LongType()),
            T.StructField("shingle", T.StringType()),
        ])
    )


def bit_set(hashes: DataFrame) -> np.ndarray:
    """The set of FILTER_BITS bits with those of `hash` set; octets with no bit do not come back, so
    the driver gets at most the size of the set."""
    spot = F.pmod(
        F.conv(F.hex("hash"), 16, 10).cast("decimal(20,0)"), F.lit(FILTER_BITS)
    ).cast("long")
    octets = hashes.select(spot.alias("spot")).groupBy(
        F.shiftright("spot", 3).alias("octet")
    ).agg(F.bit_or(F.expr("shiftleft(1, cast(spot % 8 as int))")).alias("bits"))
    found = octets.toArrow()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bits[found.column("octet").to_numpy()] = found.column("bits").to_numpy().astype(np.uint8)
    return bits


def sketches(rows: DataFrame, by: list[str], bins: str) -> DataFrame:
    """The least hash of each bin: `by`, `value`.  Hashes are compared in an order of their own, or
    the bin and the least hash would hang together."""
    order = F.xxhash64("hash")
    return rows.groupBy(*by, F.pmod(F.col("hash"), F.col(bins)).alias("bin")).agg(
        F.min_by("hash", order).alias("value")
    ).drop("bin")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    width: int = SHINGLE_WORDS,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """`doc_id`, `item_id`, `n_shared`, `n_shingles`, `containment`: the items at least `containment`
    of whose distinct word shingles stand in a document.

    Words are runs of letters and digits, lower-cased.  An item of fewer than `width` words is one
    shingle of all its words, and a document holds it if these words stand in it in a row.  A text
    without words, or null, is in nothing and holds nothing.  Rows of equal doc_id are one document,
    rows of equal item_id one item; rows without id are left out.
    """
    every_item = stored(
        shingle_rows(items.where(F.col(item_id).isNotNull()), item_id, text, width, None)
        .select(F.col("key").alias("item_id"), "hash", "shingle",
                F.size(F.split("shingle", " ")).alias("words")).distinct(),
        "items",
    )
    item_rows = every_item.where(F.col("words") == width).drop("words")
    short = [
        _short_items(docs, every_item, doc_id, text, r.words)
        for r in every_item.where(F.col("words") < width).select("words").distinct().collect()
    ]  # one frame for each number of words below `width`
    # classes by powers of two: `span` is more than the shingles of any item in the class
    sized = stored(
        item_rows.groupBy("item_id").agg(F.count("*").alias("n_shingles")).withColumn(
            "span", F.pow(F.lit(2), F.floor(F.log2("n_shingles")) + 1).cast("long")
        ),
        "item-sizes",
    )
    wanted = bit_set(item_rows)
    doc_rows = stored(
        shingle_rows(docs.where(F.col(doc_id).isNotNull()), doc_id, text, width, wanted)
        .withColumnRenamed("key", "doc_id"),
        "doc-shingles",
    )
    spans = [r.span for r in sized.select("span").distinct().collect()]  # some dozens at most
    if not spans:
        spans = [1]
    # a window of two spans begins at every span, so a passage of one span lies in one window whole
    number = F.floor(F.col("place") / F.col("span"))
    windows = (
        doc_rows.select("doc_id", "place", "hash",
                        F.explode(F.array(*map(F.lit, spans))).alias("span"))
        .select("doc_id", "hash", F.col("span").cast("long").alias("span"),
                F.explode(F.array(number, number - 1)).alias("window"))
        .withColumn("bins", F.col("span") * BINS_PER_SHINGLE)
    )
    of_windows = sketches(windows, ["doc_id", "span", "window"], "bins").select(
        "doc_id", "span", "value"
    ).distinct()
    of_items = sketches(
        item_rows.join(sized, "item_id").withColumn("bins", F.col("span") * BINS_PER_SHINGLE),
        ["item_id", "span"], "bins",
    )
    candidates = of_windows.join(of_items, ["span", "value"]).select("doc_id", "item_id").distinct()
    shared = (
        candidates
        .join(item_rows, "item_id")
        .join(doc_rows.select("doc_id", "hash", "shingle").distinct(),
              ["doc_id", "hash", "shingle"])
        .groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    )
    share = F.col("n_shared") / F.col("n_shingles")
    found = shared.join(sized, "item_id").select(
        "doc_id", "item_id", "n_shared", "n_shingles", share.alias("containment")
    ).where(F.col("containment") >= containment)
    return reduce(DataFrame.unionByName, short, found)


def _short_items(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, words: int
) -> DataFrame:
    """Documents that hold an item of exactly `words` words: their shingles of that many words are
    joined with the items."""
    wanted = items.where(F.col("words") == words).select("item_id", "hash", "shingle")
    rows = shingle_rows(
        docs.where(F.col(doc_id).isNotNull()), doc_id, text, words, bit_set(wanted)
    )
    held = rows.select(F.col("key").alias("doc_id"), "hash", "shingle").distinct()
    return held.join(wanted, ["hash", "shingle"]).select("doc_id", "item_id").distinct().select(
        "doc_id", "item_id", F.lit(1).cast("long").alias("n_shared"),
        F.lit(1).cast("long").alias("n_shingles"), F.lit(1.0).alias("containment"),
    )


def without_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that hold an item; rows without id stay."""
    found = contained_items(docs, items, **options).select("doc_id").distinct()
    return docs.join(stored(found, "contaminated"), "doc_id", "left_anti")
