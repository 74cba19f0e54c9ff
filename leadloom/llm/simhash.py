"""SimHash near-duplicates by covering codes.

Anchors are pairs of words of the binary Golay code, one for each of the two first 23-bit blocks of a
fingerprint (the last 18 bits of an anchor are zero and not looked at).  Every block lies within 3
bits of exactly one code word, so each fingerprint has one home anchor.  A fingerprint at distance
d1 and d2 from another one in the two blocks lies within 3 + d1 and 3 + d2 of that one's home: sent
to every anchor with d1 + d2 within the threshold, it meets all its neighbours at their homes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import stored
from leadloom.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
# Length, check bits and covering radius of the binary Golay code, and the
# coefficients of its generator polynomial.
BLOCK_BITS = 23
CHECK_BITS = 11
RADIUS = 3
GENERATOR = 0b110001110101
BLOCK = np.uint64((1 << BLOCK_BITS) - 1)
# Shingles whose bits are counted at once.
STEP = 1 << 15


def fingerprint(text: str | None, words_to_shingle: int = SHINGLE_WORDS) -> int:
    """64 bits, each the majority of that bit in the XXH64 of all word shingles."""
    words = (text or "").encode().lower().split()  # bytes: splits at ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    width = min(words_to_shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    hashes = np.array(
        [xxhash.xxh64_intdigest(line[a : b - 1], SEED)
         for a, b in zip(starts, ends[width - 1 :], strict=True)],
        np.uint64,
    )
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        octets = hashes[i : i + STEP].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    set_bits = 2 * counts > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", words_to_shingle: int = SHINGLE_WORDS):
    """`docs` with a `bits` column (the fingerprint as a signed number), in place of any such
    column.  A text without words, or null, has fingerprint zero."""
    docs = docs.drop("bits")
    names = [*docs.columns, "bits"]
    place = names.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("bits", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words_to_shingle) for t in batch.column(place).to_pylist()]
            bits = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, bits], names)

    return docs.mapInArrow(run, schema)


def _rest(x: np.ndarray) -> np.ndarray:
    """Remainder of a block by the generator: which coset of the code it is in."""
    x = x.copy()
    for bit in range(BLOCK_BITS - 1, CHECK_BITS - 1, -1):
        step = np.uint64(GENERATOR << (bit - CHECK_BITS))
        x ^= ((x >> np.uint64(bit)) & np.uint64(1)) * step
    return x.astype(np.int64)


def patterns(extra: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each number of bits beyond the radius, 0 to `extra`: all differences between a block and
    the code words that far from it, in order of the block's coset, and where each coset begins."""
    code = np.zeros(1 << (BLOCK_BITS - CHECK_BITS), np.uint64)
    for bit in range(BLOCK_BITS - CHECK_BITS):
        code[1 << bit : 2 << bit] = code[: 1 << bit] ^ np.uint64(GENERATOR << bit)
    leaders = np.zeros(1 << CHECK_BITS, np.uint64)
    words = np.arange(1 << BLOCK_BITS, dtype=np.uint64)
    words = words[np.bitwise_count(words) <= RADIUS]
    leaders[_rest(words)] = words
    differences, begins = [], []
    everything = leaders[:, None] ^ code[None, :]
    beyond = np.maximum(np.bitwise_count(everything).astype(np.int64) - RADIUS, 0)
    for k in range(extra + 1):
        coset, column = np.nonzero(beyond == k)
        differences.append(everything[coset, column])
        begins.append(np.searchsorted(coset, np.arange(len(leaders) + 1)))
    return differences, begins


def anchors(bits: np.ndarray, known: tuple, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """All anchors of each fingerprint: (row, anchor); anchors with nothing beyond the radius first
    in each, so `extra` 0 gives the home anchors alone."""
    differences, begins = known
    first, second = bits & BLOCK, (bits >> np.uint64(BLOCK_BITS)) & BLOCK
    cosets = _rest(first), _rest(second)

    def spread(rows: np.ndarray, coset: np.ndarray, k: int):
        begin, end = begins[k][coset], begins[k][coset + 1]
        sizes = end - begin
        heads = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(heads, sizes) + np.repeat(begin, sizes)
        return np.repeat(rows, sizes), np.repeat(np.arange(len(rows)), sizes), differences[k][at]

    every, found_rows, found = np.arange(len(bits)), [], []
    for a in range(extra + 1):
        rows, _, left = spread(every, cosets[0], a)
        for b in range(extra + 1 - a):
            both, source, right = spread(rows, cosets[1][rows], b)
            anchor = (first[both] ^ left[source]) << np.uint64(BLOCK_BITS)
            found_rows.append(both)
            found.append(anchor | (second[both] ^ right))
    return np.concatenate(found_rows), np.concatenate(found).astype(np.int64)


def at_anchors(bits: DataFrame, extra: int) -> DataFrame:
    """`bits` (distinct fingerprints) at every anchor within reach: `anchor`, `bits`."""
    shared = bits.sparkSession.sparkContext.broadcast(patterns(extra))  # fixed by the code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(values), 4096):
                part = values[i : i + 4096]
                rows, places = anchors(part.view(np.uint64), shared.value, extra)
                yield pa.RecordBatch.from_pydict({"anchor": places, "bits": part[rows]})

    return bits.select("bits").mapInArrow(run, "anchor long, bits long")


def links(bits: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All pairs u < v of the distinct fingerprints `bits` at most `max_bits` apart, each once.

    Smaller fingerprints wait at home, larger ones come to all anchors in reach; a join on the anchor
    compares them, and adaptive execution splits an anchor with many.  Both sides are shuffled: Spark
    takes the guests for as many as the fingerprints, dozens of times too few, and would broadcast
    them.
    """
    homes = at_anchors(bits, 0).withColumnRenamed("bits", "u")
    guests = at_anchors(bits, max_bits).withColumnRenamed("bits", "v")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    met = homes.join(guests.hint("merge"), "anchor")
    return met.where((F.col("u") < F.col("v")) & near).select("u", "v")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    words_to_shingle: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """`doc_id`, `fingerprint` (16 hex digits), `component_id` (smallest doc_id reachable over links)
    for every row of `docs`.

    Rows of equal fingerprint are one node, so copies cost nothing beyond their own row.  Rows with
    a null id take part in links but give no component its name; a component without ids has null.
    """
    marked = stored(
        fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                     "text", words_to_shingle).select("doc_id", "bits"),
        "fingerprints",
    )
    nodes = stored(
        marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "fingerprint-nodes"
    )
    roots = components(links(nodes, max_bits))
    grouped = nodes.join(roots.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root")
    )
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = stored(
        grouped.join(names, "root").select("bits", "component_id"), "fingerprint-components"
    )
    # as many rows on either side as the input has: shuffled, however small the files are
    return marked.join(placed.hint("merge"), "bits").select(
        "doc_id",
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """`docs` without the documents whose component has one with a smaller id; of rows of equal id
    all stay or all go.  Rows without an id stay."""
    gone = near_duplicates(docs, **options).where("doc_id <> component_id").select("doc_id")
    return docs.join(stored(gone.distinct(), "near-duplicates"), "doc_id", "left_anti")
