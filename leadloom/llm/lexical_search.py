"""Ranked lexical search by the Best Position Algorithm.

Every task holds some of the documents: for each term of the items a list of its documents by falling
impact, and for each document its terms.  An item's lists are read together.  A document met in one
list is looked up in all others, which marks its places there as seen; the best position of a list
ends its unbroken run of seen places, and the next read goes directly behind it.  A document not met
yet scores at most what the best positions give together, so reading stops once that lies strictly
below the score of rank k.  The tasks' best are merged.

Items are a query set: they are taken in blocks of bounded text, each block against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import PUNCTUATION, stored

TOP = 20
# Scale of the weights, scale, saturation and length share of the impacts.
WEIGHT_SCALE = 1000
IMPACT_SCALE = 1_000_000_000
SATURATION = 12
LENGTH_PERCENT = 25
# Text of the items that are searched for together.
BLOCK_BYTES = 4 << 20
# Term entries of the documents that a task searches together.
SHARD_ENTRIES = 4 << 20
# Places read from every list in the first round; each later round reads twice as many.
FIRST_READ = 32
# Text that is split into words at once.
STEP_BYTES = 1 << 20
# A-Z as a-z, all other ASCII but letters and digits as space.
_PLAIN = bytes(0x20 if PUNCTUATION[b] else b for b in range(256)).lower()


def term_counts(text: str | None) -> Counter[bytes]:
    """How often each term stands in a text; terms are runs of letters, digits and all characters
    beyond ASCII, A-Z lower-cased."""
    raw = (text or "").encode().translate(_PLAIN)
    counts: Counter[bytes] = Counter()
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + STEP_BYTES)
        end = len(raw) if end < 0 else end
        counts.update(raw[at:end].split())
        at = end
    return counts


def item_block(items: DataFrame, item_id: str, text: str) -> tuple[list, list[bytes], list, list]:
    """Ids, distinct terms, and for each item the numbers of its terms and their repeats, of a block
    of items (BLOCK_BYTES of text or one longer item); rows of equal id are one item."""
    counts: dict = {}
    for row in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).collect():
        counts.setdefault(row.i, Counter()).update(term_counts(row.t))
    number: dict[bytes, int] = {}
    terms = [np.array([number.setdefault(t, len(number)) for t in c], np.int64)
             for c in counts.values()]
    repeats = [np.array(list(c.values()), np.int64) for c in counts.values()]
    return list(counts), list(number), terms, repeats


def document_terms(docs: DataFrame, doc_id: str, text: str, terms: list[bytes]) -> DataFrame:
    """`doc_id`, `size` (all terms), `terms` (numbers of those in `terms`) and `counts` of the documents
    with a term at all."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # of one block of items
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("size", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            rows, sizes, found, counts = [], [], [], []
            for row, cell in enumerate(batch.column(1)):
                every = term_counts(cell.as_py())
                if every:
                    held = every.keys() & number.keys()
                    rows.append(row)
                    sizes.append(every.total())
                    found.append([number[t] for t in held])
                    counts.append([every[t] for t in held])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "size", "terms", "counts"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, schema
    )


def term_weights(frequency: np.ndarray, documents: int) -> np.ndarray:
    return np.array(
        [math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * int(f) + 1)))
         for f in frequency],
        np.int64,
    )


class Shard:
    """Some documents, their terms both ways: by document, and by term in order of falling impact."""

    def __init__(self, starts, terms, impacts, n_terms: int):
        self.starts, self.terms, self.impacts = starts, terms, impacts
        order = np.lexsort((-impacts, terms))
        self.document = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[order]
        self.falling = impacts[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.heads = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=n_terms))])
        self.times = np.zeros(n_terms, np.int64)

    def look_up(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores of documents that hold a term, and all places of the item's lists they take."""
        sizes = self.starts[documents + 1] - self.starts[documents]
        heads = np.cumsum(sizes) - sizes
        entries = np.arange(sizes.sum()) + np.repeat(self.starts[documents] - heads, sizes)
        times = self.times[self.terms[entries]]
        scores = np.add.reduceat(times * self.impacts[entries], heads)
        return scores, self.place[entries[times > 0]]

    def search(self, terms: np.ndarray, repeats: np.ndarray, top: int):
        """Documents, each once, and scores: among them the `top` best, with all equal to the last."""
        heads, ends = self.heads[terms], self.heads[terms + 1]
        full = ends > heads
        terms, repeats, best, ends = terms[full], repeats[full], heads[full].copy(), ends[full]
        self.times[terms] = repeats
        seen = np.zeros(len(self.document), bool)
        met = np.zeros(len(self.starts) - 1, bool)
        documents, scores, read = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], FIRST_READ
        leaders = np.zeros(0, np.int64)
        while (best < ends).any():
            spans = [self.document[b : min(b + read, e)]
                     for b, e in zip(best, ends, strict=True)]
            fresh = np.unique(np.concatenate(spans))
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            found, places = self.look_up(fresh)
            seen[places] = True
            documents.append(fresh)
            scores.append(found)
            leaders = np.sort(np.concatenate([leaders, found]))[-top:]
            for i, (b, e) in enumerate(zip(best, ends, strict=True)):
                rest = seen[b:e]
                best[i] = e if rest.all() else b + int(rest.argmin())
            open_ = best < ends
            bound = int((repeats[open_] * self.falling[best[open_] - 1]).sum())
            if len(leaders) == top and bound < leaders[0]:
                break
            read *= 2
        self.times[terms] = 0
        return np.concatenate(documents), np.concatenate(scores)


def _shards(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("terms").flatten())
        if size >= entries:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def best_documents(
    held: DataFrame, block: tuple, documents: int, length: int, weights: np.ndarray, top: int,
    shard_entries: int,
) -> DataFrame:
    """`item` (its number), `doc_id`, `score`: the `top` of every item in each shard of `held`."""
    _, numbers, item_terms, item_repeats = block
    shared = held.sparkSession.sparkContext.broadcast((weights, item_terms, item_repeats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, every_terms, every_repeats = shared.value
        for table in _shards(batches, shard_entries):
            table = table.combine_chunks()
            ids = table.column("doc_id").combine_chunks()
            order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            sizes = table.column("size").to_numpy()
            lengths = pc.list_value_length(table.column("terms")).to_numpy()
            starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            terms = pc.list_flatten(table.column("terms")).to_numpy()
            counts = pc.list_flatten(table.column("counts")).to_numpy()
            norm = 100 - LENGTH_PERCENT + LENGTH_PERCENT * sizes * documents // length
            impacts = weight[terms] * (
                IMPACT_SCALE * counts
                // (WEIGHT_SCALE * counts + SATURATION * np.repeat(norm, lengths))
            )
            shard = Shard(starts, terms, impacts, len(numbers))
            items, rows, values = [], [], []
            for i, (t, r) in enumerate(zip(every_terms, every_repeats, strict=True)):
                found, scores = shard.search(t, r, top)
                found, scores = found[scores > 0], scores[scores > 0]
                first = np.lexsort((rank[found], -scores))[:top]
                items.append(np.full(len(first), i))
                rows.append(found[first])
                values.append(scores[first])
            if items:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(items)), ids.take(pa.array(np.concatenate(rows))),
                     pa.array(np.concatenate(values))],
                    ["item", "doc_id", "score"],
                )

    schema = T.StructType([
        T.StructField("item", T.LongType()), held.schema["doc_id"],
        T.StructField("score", T.LongType()),
    ])
    return held.mapInArrow(run, schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
    shard_entries: int = SHARD_ENTRIES,
) -> DataFrame:
    """`item_id`, `rank`, `doc_id`, `score`: the `top` documents of highest score above zero for each
    item, equal scores by ascending doc_id, rows without id last.

    Every row of `docs` is a document, also if ids repeat; a null text is empty, and texts without
    terms do not count.  Rows of `items` with equal id are one item, those without id are left out.
    An item whose terms stand nowhere has no row.
    """
    spark = docs.sparkSession
    items = items.where(F.col(item_id).isNotNull()).select(item_id, text)
    size = items.agg(F.sum(F.octet_length(text)).alias("size")).first().size or 0
    blocks = size // block_bytes + 1
    schema = T.StructType([
        T.StructField("item_id", items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()),
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType()),
    ])
    results = []
    for number in range(blocks):
        block = item_block(
            items.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == number), item_id, text
        )
        ids, terms, _, _ = block
        if not terms:
            continue
        held = stored(document_terms(docs, doc_id, text, terms), "document-terms")
        total = held.agg(F.count("*").alias("documents"), F.sum("size").alias("length")).first()
        if not total.documents:
            continue
        frequency = np.zeros(len(terms), np.int64)
        holders = held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        frequency[holders["term"].to_numpy()] = holders["count"].to_numpy()
        weights = term_weights(frequency, total.documents)
        best = best_documents(
            held, block, total.documents, total.length, weights, top, shard_entries
        )
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        names = spark.createDataFrame(
            pa.table({"item": pa.array(range(len(ids)), pa.int64()), "item_id": pa.array(ids)})
        )
        results.append(
            stored(
                best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
                .join(F.broadcast(names), "item")  # the ids of one block
                .select(F.col("item_id").cast(schema["item_id"].dataType).alias("item_id"),
                        "rank", "doc_id", "score"),
                "found",
            )
        )
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
