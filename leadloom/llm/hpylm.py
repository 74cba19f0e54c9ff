"""A hierarchical Pitman-Yor language model: seating by Gibbs sampling, scores of whole texts.

Restaurants.  The root seats words without context.  Every word that some training token follows, the
end of a text included, has a restaurant of its own for what follows it; all share the root as parent.

Places.  Entries (word, context) are dealt to cells by the hash of the word; those of a word that is
HOT_SHARE of all training tokens by the hash of both, so no cell gets a hot word whole.  Cells count
entries.  Words go to buckets by their hash: as words with their seats in all restaurants, as contexts
with the number of their tables.  An entry of one customer has one table in every seating: it is a
customer of the root that stays, so only entries of several customers take part in the sweeps.

Sampling.  One sweep takes every word in every restaurant in turn: all its customers get up and are
seated again one by one by the Chinese restaurant rule, given everybody else, and the new seating is
kept with the Metropolis probability that makes this a Gibbs step for the whole group.  Tables of a
context are customers of the root.  Buckets work side by side with the numbers of tables that the
last sweep left behind: after each sweep they send the tables of every context they hold to the
bucket of that context and get the sum back.  Probabilities are averaged over the sweeps after the
burn-in.

Disk.  Every step is written, and the shuffle files and rows behind it go as soon as nothing reads
them; the result reads blocks and their answers only, which are compressed where they are made.

Traffic.  Blocks of documents send every distinct word and (context, word) once and get its seats
back, so a word in a third of all tokens costs one row per block.  The driver holds hot words (at most
1 / HOT_SHARE) and two sums per sweep.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import (
    blocks_of,
    by_bucket,
    drop_stored,
    give_back,
    mix,
    pack,
    pack_sorted,
    stored_alone,
    unpack,
    unpack_sorted,
    word_hashes,
    words_of,
)

HOT_SHARE = 1 / 4096
BURN_IN = 2
SAMPLES = 3
# Concentrations of contexts and of the root; discounts follow from the counts.
CONTEXT_STRENGTH = 1.0
ROOT_STRENGTH = 1.0
BLOCK_BYTES = 8 << 20
# Text whose entries make a cell, and text whose words make a bucket.
CELL_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20
# Customers seated one by one; later ones of a large group go in lots of a fraction of those seated.
ONE_BY_ONE = 64
LOT = 1 / 32
SEED = 7
# The end of a text, a word of its own.
END = mix(np.array([0x454E44], np.uint64))[0]


def tokens(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token of all texts, an end behind each text, and where each text begins."""
    begins, ends, first = words_of(raw, starts)
    first = first + np.arange(len(first))  # one end for each text before
    found = np.full(first[-1], END, np.uint64)
    is_word = np.ones(len(found), bool)
    is_word[first[1:] - 1] = False
    found[is_word] = word_hashes(raw, begins, ends)
    return found, first


@dataclass
class Restaurants:
    """What a bucket knows of the others: its contexts (hashes, ascending; their customers) and, after
    each sweep, the tables of each of them and the root's customers and tables."""

    words: int  # distinct training words
    tokens: int
    contexts: np.ndarray
    customers: np.ndarray
    discounts: tuple[float, float] = (0.5, 0.5)
    swept: list[tuple[np.ndarray, float, float]] = field(default_factory=list)


@dataclass
class Bucket:
    """Training counts of some words: `context` 0 is the root itself, i the context i - 1."""

    words: np.ndarray
    counts: np.ndarray  # of each word
    home: np.ndarray  # of each entry: index of its word
    context: np.ndarray
    customers: np.ndarray


def seat(
    customers: np.ndarray, weight: np.ndarray, discount: float, random: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """Seat groups of customers of one dish each by the Chinese restaurant rule: the tables of each
    group, and the log of the normalisers on the way, which the acceptance needs.

    `weight` is what a new table weighs at the first customer: concentration plus discount times the
    other tables, times the dish's base probability; `weight` has two rows, the second one is added
    for every table of the group itself.
    """
    first, each = weight
    tables = np.ones(len(customers), np.int64)
    logs = np.zeros(len(customers))
    seated = 1
    alive = np.flatnonzero(customers > 1)
    while len(alive):
        lot = 1 if seated < ONE_BY_ONE else max(1, int(seated * LOT))
        now = np.minimum(lot, customers[alive] - seated)
        new = first[alive] + each[alive] * tables[alive]
        total = new + seated - discount * tables[alive]
        logs[alive] += now * np.log(total)
        if lot == 1:
            tables[alive] += random.random(len(alive)) * total < new
        else:
            tables[alive] += random.binomial(now, new / total)
        seated += lot
        alive = alive[customers[alive] > seated]
    return tables, logs


def accepted(
    old: np.ndarray, logs: np.ndarray, random: np.random.Generator
) -> np.ndarray:
    """Which proposals replace the seating before, whose normalisers were `old` (nan: none yet)."""
    gain = np.where(np.isnan(old), 0.0, logs - np.nan_to_num(old))
    return np.log(random.random(len(logs))) < gain


class Seating:
    """Tables of one bucket in a sweep; the same seats and totals give the same tables."""

    def __init__(self, bucket: Bucket, shared: Restaurants, number: int, sweep: int = 0):
        self.bucket, self.shared = bucket, shared
        self.random = np.random.default_rng([SEED, number, sweep])
        self.inner = np.flatnonzero((bucket.context > 0) & (bucket.customers > 0))
        self.tables = np.zeros(len(bucket.customers), np.int64)
        self.tables[self.inner] = 1
        self.logs = np.full(len(bucket.customers), np.nan)
        direct = (bucket.context == 0) & (bucket.customers > 0)
        self.direct = np.bincount(
            bucket.home[direct], bucket.customers[direct], len(bucket.words)
        ).astype(np.int64)
        self.root_customers = self.of_root()
        self.root_tables = (self.root_customers > 0).astype(np.int64)
        self.root_logs = np.full(len(bucket.words), np.nan)

    def of_root(self) -> np.ndarray:
        sent = np.bincount(
            self.bucket.home[self.inner], self.tables[self.inner], len(self.bucket.words)
        )
        return self.direct + sent.astype(np.int64)

    def root_probability(self, history: tuple[np.ndarray, float, float]) -> np.ndarray:
        """Of each word, from the seats here and the totals everywhere."""
        _, customers, tables = history
        discount = self.shared.discounts[1]
        own = np.maximum(self.root_customers - discount * self.root_tables, 0.0)
        spare = (ROOT_STRENGTH + discount * tables) / (self.shared.words + 1)
        return (own + spare) / (ROOT_STRENGTH + customers)

    def unseen_probability(self, history: tuple[np.ndarray, float, float]) -> float:
        _, customers, tables = history
        spare = ROOT_STRENGTH + self.shared.discounts[1] * tables
        return spare / (self.shared.words + 1) / (ROOT_STRENGTH + customers)

    def totals(self) -> tuple[np.ndarray, float, float]:
        of_contexts = np.bincount(
            self.bucket.context[self.inner], self.tables[self.inner],
            len(self.shared.contexts) + 1,
        )
        return of_contexts, float(self.root_customers.sum()), float(self.root_tables.sum())

    def sweep(self, history: tuple[np.ndarray, float, float]) -> None:
        inner_discount, root_discount = self.shared.discounts
        base = self.root_probability(history)
        busy = self.inner[self.bucket.customers[self.inner] > 1]
        if len(busy):
            chance = base[self.bucket.home[busy]]
            others = history[0][self.bucket.context[busy]] - self.tables[busy]
            weight = np.stack([
                (CONTEXT_STRENGTH + inner_discount * np.maximum(others, 0)) * chance,
                inner_discount * chance,
            ])
            tables, logs = seat(
                self.bucket.customers[busy], weight, inner_discount, self.random
            )
            keep = accepted(self.logs[busy], logs, self.random)
            self.tables[busy[keep]], self.logs[busy[keep]] = tables[keep], logs[keep]
        before = self.root_customers
        self.root_customers = self.of_root()
        # seats of a word whose customers came or went cannot stay
        self.root_logs[before != self.root_customers] = np.nan
        self.root_tables = np.minimum(self.root_tables, self.root_customers)
        busy = np.flatnonzero(self.root_customers > 1)
        if len(busy):
            each = 1 / (self.shared.words + 1)
            others = history[2] - self.root_tables[busy]
            weight = np.stack([
                (ROOT_STRENGTH + root_discount * np.maximum(others, 0)) * each,
                np.full(len(busy), root_discount * each),
            ])
            tables, logs = seat(self.root_customers[busy], weight, root_discount, self.random)
            keep = accepted(self.root_logs[busy], logs, self.random)
            self.root_tables[busy[keep]], self.root_logs[busy[keep]] = tables[keep], logs[keep]
        single = self.root_customers <= 1
        self.root_tables[single] = self.root_customers[single]

    def seats(self) -> dict:
        """All that a sweep leaves to the next one."""
        busy = self.inner
        return {
            "a": pack(self.tables[busy].astype(np.uint32)), "b": pack(self.logs[busy]),
            "c": pack(self.root_customers.astype(np.uint64)),
            "d": pack(self.root_tables.astype(np.uint64)), "e": pack(self.root_logs),
        }

    def take_seats(self, row: dict) -> None:
        self.tables[self.inner] = unpack(row["a"], np.uint32)
        self.logs[self.inner] = unpack(row["b"], np.float64)
        self.root_customers = unpack(row["c"], np.uint64).astype(np.int64)
        self.root_tables = unpack(row["d"], np.uint64).astype(np.int64)
        self.root_logs = unpack(row["e"], np.float64)


def word_counts(docs: DataFrame, train: str) -> DataFrame:
    """`word` (hash), `n`: every training token's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, starts in blocks_of(batches, 0, BLOCK_BYTES):
            chosen = batch.column(1).to_numpy(zero_copy_only=False)
            found, first = tokens(raw, starts)
            words, counts = np.unique(
                found[np.repeat(chosen.astype(bool), np.diff(first))], return_counts=True
            )
            yield pa.RecordBatch.from_pydict({"word": words.view(np.int64), "n": counts})
            give_back()

    return (
        docs.select("text", train).mapInArrow(run, "word long, n long")
        .groupBy("word").agg(F.sum("n").alias("n"))
    )


# Before the kind of a row whose binary cells are compressed.
SQUEEZED = "squeezed "
# Rows between the steps: what they are, where they go, whom they are from, and packed numbers.
ROWS = (
    "kind string, place int, source long, a binary, b binary, c binary, d binary, e binary, "
    "x double, y double"
)
_SCHEMA = pa.schema([
    ("kind", pa.string()), ("place", pa.int32()), ("source", pa.int64()),
    *((name, pa.binary()) for name in "abcde"), ("x", pa.float64()), ("y", pa.float64()),
])


def _rows(table: pa.Table | pa.RecordBatch) -> dict[str, list[dict]]:
    """The rows by kind, each kind in the order of its sources; squeezed ones as they were."""
    found: dict[str, list[dict]] = {}
    for row in table.to_pylist():
        if row["kind"].startswith(SQUEEZED):
            row = loosened(row) | {"kind": row["kind"].removeprefix(SQUEEZED)}
        found.setdefault(row["kind"], []).append(row)
    for rows in found.values():
        rows.sort(key=lambda r: (r["source"] is not None, r["source"]))
    return found


def _u32(values: np.ndarray) -> bytes:
    return pack(values.astype(np.uint32))


def _ints(data: bytes, dtype=np.uint32) -> np.ndarray:
    return unpack(data, dtype).astype(np.int64)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for column in columns:
        fresh[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(fresh)


def _sums(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, heads) if len(heads) else np.zeros(0, values.dtype)


def _joined(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    return by_bucket(keys, buckets) if len(keys) else iter(())


def arrange(
    words: np.ndarray, word: np.ndarray, sizes: np.ndarray, hot: np.ndarray, cells: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a block in the order of their cells: the entry of each token, and of each entry its
    word, its context and its cell."""
    first = np.cumsum(sizes) - sizes
    before = np.empty(len(word), np.int64)
    before[1:] = word[:-1]
    before[first] = np.searchsorted(words, END)  # a text begins behind an end
    entries, index = np.unique(word * len(words) + before, return_inverse=True)
    home, context = entries // len(words), entries % len(words)
    key = words[home]
    split = np.isin(words, hot)[home]
    key[split] = mix(key[split] ^ mix(words[context[split]]))
    cell = (((key >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[index], home[order], context[order], cell[order]


def squeezed(row: dict) -> dict:
    """Compressed bytes in all binary cells of a row: planes of numbers lose less to the codec of a
    shuffle, and neither the JVM nor its way to Python holds the rows in full."""

    codec = pa.Codec("zstd", compression_level=3)

    def shrunk(data: bytes) -> bytes:
        size = len(data).to_bytes(8, "little")
        return size + codec.compress(data, asbytes=True) if data else size

    return {k: shrunk(v) if isinstance(v, bytes) else v for k, v in row.items()}


def loosened(row: dict) -> dict:
    """A row of `squeezed` as it was."""

    def whole(data: bytes) -> bytes:
        size = int.from_bytes(data[:8], "little")
        return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""

    return {k: whole(v) if isinstance(v, bytes) else v for k, v in row.items()}


BLOCKS = (
    "block long, docs binary, held binary, sizes binary, words binary, tokens binary"
)


def block_rows(docs: DataFrame, train: str) -> DataFrame:
    """One row per block, `squeezed`: its documents as numbers of the block's distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, starts in blocks_of(batches, 1, BLOCK_BYTES):
            found, first = tokens(raw, starts)
            if not len(found):
                continue
            chosen = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            words, word = np.unique(found, return_inverse=True)
            ids = batch.column(0)
            row = {
                "block": int.from_bytes(os.urandom(8), "little", signed=True),
                "docs": pack(ids.fill_null(0).to_numpy().astype(np.int64))
                + pack(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)),
                "held": pack((~chosen).astype(np.uint8)),
                "sizes": pack(np.diff(first).astype(np.int64)),
                "words": pack_sorted(words), "tokens": _u32(word),
            }
            yield pa.RecordBatch.from_pylist([squeezed(row)], pa.schema([
                ("block", pa.int64()),
                *((n, pa.binary()) for n in ("docs", "held", "sizes", "words", "tokens")),
            ]))
            give_back()

    return docs.select("doc_id", "text", train).mapInArrow(run, BLOCKS)


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (unpack_sorted(row["words"], np.uint64), _ints(row["tokens"]),
            unpack(row["sizes"], np.int64))


def entry_rows(row: dict, hot: np.ndarray, cells: int) -> Iterator[dict]:
    """For each cell the distinct words of a block, the contexts of each, and how often training
    documents have them."""
    words, word, sizes = _block(row)
    index, home, context, cell = arrange(words, word, sizes, hot, cells)
    trained = np.repeat(unpack(row["held"], np.uint8) == 0, sizes)
    customers = np.bincount(index[trained], minlength=len(home))
    cuts = np.append(_heads(cell), len(cell))
    for a, b in zip(cuts, cuts[1:], strict=False):
        heads = _heads(home[a:b])
        yield {
            "kind": "ask", "place": int(cell[a]), "source": row["block"],
            "a": pack_sorted(words[home[a:b][heads]]), "b": _u32(np.diff(heads, append=b - a)),
            "c": pack(words[context[a:b]]), "d": _u32(customers[a:b]),
        }


def word_rows(row: dict, buckets: int) -> Iterator[dict]:
    words = unpack_sorted(row["words"], np.uint64)
    for bucket, part in by_bucket(words, buckets):
        yield {"kind": "ask", "place": bucket, "source": row["block"],
               "a": pack_sorted(words[part])}


def asked(blocks: DataFrame, rows_of, *options) -> DataFrame:
    """What blocks ask for, `squeezed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            for found in rows_of(loosened(one.to_pylist()[0]), *options):
                own = squeezed(found) | {"kind": SQUEEZED + found["kind"]}
                yield pa.RecordBatch.from_pylist([own], _SCHEMA)
            give_back()

    return blocks.mapInArrow(run, ROWS)


def merge_cells(buckets: int):
    """Counts of a cell's entries from those of all blocks.  `index`: which entry (from 1; 0: no
    training document has it) each asked one is; `counts`: customers of each entry; `busy`: to the
    buckets of words, with the entries of several customers; `single`: to the buckets of contexts."""

    def run(key, table):
        cell, asked = key[0].as_py(), _rows(table)["ask"]
        del table
        parts, contexts, customers = [], [], []
        for r in asked:
            parts.append(np.repeat(unpack_sorted(r["a"], np.uint64), _ints(r["b"])))
            contexts.append(unpack(r["c"], np.uint64))
            customers.append(_ints(r["d"]))
            r["a"] = r["b"] = r["c"] = r["d"] = None
        cuts = np.cumsum([0, *map(len, parts)])
        word, context = np.concatenate(parts), np.concatenate(contexts)
        customers = np.concatenate(customers)
        del parts, contexts
        order = np.lexsort((context, word))
        word, context = word[order], context[order]
        heads = _heads(word, context)
        sizes = np.diff(heads, append=len(word))
        n = _sums(customers[order], heads)
        word, context = word[heads], context[heads]
        number = np.cumsum(n > 0) * (n > 0)
        index = np.empty(len(order), np.uint32)
        index[order] = np.repeat(number, sizes)
        rows = [
            {"kind": "index", "place": cell, "source": r["source"], "a": _u32(index[a:b])}
            for r, a, b in zip(asked, cuts, cuts[1:], strict=False)
        ]
        word, context, n = word[n > 0], context[n > 0], n[n > 0]
        if len(n):
            rows.append({"kind": "counts", "place": cell, "a": pack(n.astype(np.uint64))})
        heads = _heads(word)
        every, busy = word[heads], n > 1
        of_word = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(word)))
        all_n = _sums(n, heads)
        per_word = np.bincount(of_word[busy], minlength=len(every))
        single = np.bincount(of_word[~busy], minlength=len(every))
        ends = np.append(0, np.cumsum(per_word))
        busy_context, busy_n = context[busy], n[busy]
        for bucket, part in _dealt(every, buckets):
            a, b = ends[part.start], ends[part.stop]
            rows.append({
                "kind": "busy", "place": bucket, "source": cell, "a": pack_sorted(every[part]),
                "b": pack(np.concatenate([all_n[part], single[part], per_word[part]])
                          .astype(np.uint64)),
                "c": pack(busy_context[a:b]), "d": pack(busy_n[a:b].astype(np.uint64)),
            })
        alone, count = np.unique(context[~busy], return_counts=True)
        for bucket, part in _dealt(alone, buckets):
            rows.append({"kind": "single", "place": bucket, "source": cell,
                         "a": pack_sorted(alone[part]), "b": _u32(count[part])})
        return pa.Table.from_pylist(rows, _SCHEMA)

    return run


def make_buckets(buckets: int):
    """`bucket`: the words of a bucket with their counts, entries of several customers and contexts;
    `seat`: which entries each cell sent; `ask`: contexts it holds, to their buckets."""

    def run(key, table):
        place, rows = key[0].as_py(), _rows(table)["busy"]
        words, numbers, contexts, customers, source = [], [], [], [], []
        for r in rows:
            words.append(unpack_sorted(r["a"], np.uint64))
            numbers.append(_ints(r["b"], np.uint64).reshape(3, -1))
            contexts.append(unpack(r["c"], np.uint64))
            customers.append(_ints(r["d"], np.uint64))
        every, word = np.unique(np.concatenate(words), return_inverse=True)
        total = np.concatenate(numbers, axis=1)
        counts = np.bincount(word, total[0], len(every)).astype(np.uint64)
        direct = np.bincount(word, total[1], len(every)).astype(np.uint64)
        home, context = np.repeat(word, total[2]), np.concatenate(contexts)
        known, context = np.unique(context, return_inverse=True)
        order = np.lexsort((context, home))
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        found = [{
            "kind": "bucket", "place": place, "a": pack_sorted(every),
            "b": pack(np.concatenate([counts, direct])),
            "c": _u32(np.bincount(home, minlength=len(every))), "d": _u32(context[order]),
            "e": pack(np.concatenate(customers)[order].astype(np.uint64)), "x": len(known),
        }]
        cuts = np.cumsum([0, *map(len, contexts)])
        found += [
            {"kind": "seat", "place": place, "source": r["source"], "a": _u32(at[a:b])}
            for r, a, b in zip(rows, cuts, cuts[1:], strict=False)
        ]
        found += [
            {"kind": "link", "place": bucket, "source": place, "a": pack_sorted(known[part])}
            for bucket, part in _dealt(known, buckets)
        ]
        return pa.Table.from_pylist(found, _SCHEMA)

    return run


def make_contexts(key, table):
    """`context`: the contexts of a bucket and how many entries of one customer each has; `link`:
    which of them each bucket of words holds."""
    place, rows = key[0].as_py(), _rows(table)
    single, links = rows.get("single", []), rows.get("link", [])
    lists = [unpack_sorted(r["a"], np.uint64) for r in [*single, *links]]
    every, index = np.unique(np.concatenate(lists), return_inverse=True)
    cuts = np.cumsum([0, *map(len, lists)])
    fixed = np.bincount(
        index[: cuts[len(single)]], _joined([_ints(r["b"]) for r in single], np.int64), len(every)
    )
    found = [{"kind": "context", "place": place, "a": pack_sorted(every),
              "b": pack(fixed.astype(np.uint64))}]
    found += [
        {"kind": "link", "place": place, "source": r["source"], "a": _u32(index[a:b])}
        for r, a, b in zip(links, cuts[len(single) :], cuts[len(single) + 1 :], strict=False)
    ]
    return pa.Table.from_pylist(found, _SCHEMA)


def read_bucket(row: dict) -> Bucket:
    """Entries of one customer stand as customers of the root."""
    words = unpack_sorted(row["a"], np.uint64)
    counts, direct = _ints(row["b"], np.uint64).reshape(2, -1)
    home = np.repeat(np.arange(len(words)), _ints(row["c"]))
    return Bucket(
        words, counts, np.concatenate([np.arange(len(words)), home]),
        np.concatenate([np.zeros(len(words), np.int64), _ints(row["d"]) + 1]),
        np.concatenate([direct, _ints(row["e"], np.uint64)]),
    )


def count_discount(once: float, twice: float) -> float:
    """The discount that fits how many groups have one and two customers."""
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once + twice else 0.5


def small_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in (r for b in batches for r in b.to_pylist()):
        bucket = read_bucket(row)
        inner, alone = bucket.customers[bucket.context > 0], bucket.customers[bucket.context == 0]
        root = np.bincount(
            bucket.home, np.where(bucket.context == 0, bucket.customers, 1), len(bucket.words)
        )
        yield pa.RecordBatch.from_pydict({
            "i1": [int(alone.sum())], "i2": [int((inner == 2).sum())],
            "r1": [int((root == 1).sum())], "r2": [int((root == 2).sum())],
        })


def sweep_buckets(sweep: int, shared: Restaurants, buckets: int):
    """A sweep of a bucket, the first one being the seats before all.  `seats`: what it leaves to the
    next; `tables`: of each context it holds, to their buckets."""

    def run(key, table):
        place, rows = key[0].as_py(), _rows(table)
        bucket = read_bucket(rows["bucket"][0])
        n = int(rows["bucket"][0]["x"])
        seating = Seating(
            bucket, Restaurants(shared.words, shared.tokens, np.zeros(n), np.zeros(n),
                                shared.discounts), place, sweep
        )
        if sweep:
            seating.take_seats(rows["seats"][0])
            totals = _joined([_ints(r["a"], np.uint64) for r in rows.get("sum", [])], np.int64)
            seating.sweep((np.concatenate([[0], totals]), *shared.swept[sweep - 1][1:]))
        of_contexts, customers, tables = seating.totals()
        found = [{"kind": "seats", "place": place, "x": customers, "y": tables, **seating.seats()}]
        at = 0
        for r in rows.get("target", []):
            size = int(r["x"])
            part = of_contexts[1 + at : 1 + at + size]
            found.append({"kind": "tables", "place": r["source"], "source": place,
                          "a": _u32(part)})
            at += size
        return pa.Table.from_pylist(found, _SCHEMA)

    return run


def sum_contexts(key, table):
    """`sum`: the tables of contexts, to the buckets that hold them; `total`: all of them."""
    place, rows = key[0].as_py(), _rows(table)
    total = _ints(rows["context"][0]["b"], np.uint64)
    links = {r["source"]: _ints(r["a"]) for r in rows.get("link", [])}
    for r in rows.get("tables", []):
        total[links[r["source"]]] += _ints(r["a"])
    found = [{"kind": "total", "place": place, "a": pack(total.astype(np.uint64))}]
    found += [
        {"kind": "sum", "place": int(source), "source": place, "a": pack(total[at].astype(np.uint64))}
        for source, at in links.items()
    ]
    return pa.Table.from_pylist(found, _SCHEMA)


def _step(
    rows: list[DataFrame], function, purpose: str, compressed: bool = False
) -> DataFrame:
    """The rows that a function makes of those of each place, written; `squeezed` on request."""
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)

    def run(key, table):
        rows = function(key, table)
        del table
        if compressed:
            rows = pa.Table.from_pylist([squeezed(r) for r in rows.to_pylist()], _SCHEMA)
        give_back()
        return rows

    found = every.groupBy("place").applyInArrow(run, ROWS)
    return stored_alone(found, purpose)


def _kind(frame: DataFrame, *kinds: str) -> DataFrame:
    return frame.where(F.col("kind").isin(*kinds))


def train(words: DataFrame, contexts: DataFrame, shared: Restaurants, buckets: int):
    """Run the sweeps: the seats after each sampled one and the tables of all contexts; `shared` gets
    the sums for the root."""
    model = _kind(words, "bucket")
    few = model.mapInArrow(small_groups, "i1 long, i2 long, r1 long, r2 long").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("i1", "i2", "r1", "r2"))
    ).first()
    shared.discounts = count_discount(few.i1, few.i2), count_discount(few.r1, few.r2)
    # how many of its contexts a bucket sends where
    target = _kind(words, "link").select(
        F.lit("target").alias("kind"), F.col("source").cast("int").alias("place"),
        F.col("place").cast("long").alias("source"),
        *(F.lit(None).cast("binary").alias(c) for c in "abcde"),
        (F.octet_length("a") / 8).alias("x"), F.lit(None).cast("double").alias("y"),
    )
    seats, sums = [], []
    for sweep in range(BURN_IN + SAMPLES + 1):
        before = [_kind(seats[-1], "seats"), _kind(sums[-1], "sum")] if sweep else []
        seats.append(_step(
            [model, target, *before], sweep_buckets(sweep, shared, buckets), "lm-seats"
        ))
        root = _kind(seats[-1], "seats").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).first()
        shared.swept.append((np.zeros(0), root.x or 0.0, root.y or 0.0))
        sums.append(_step([contexts, _kind(seats[-1], "tables")], sum_contexts, "lm-sums"))
        if 0 < sweep <= BURN_IN + 1:  # nothing reads a sweep before the samples twice
            drop_stored(seats[sweep - 1], sums[sweep - 1])
    return seats[BURN_IN + 1 :], sums[BURN_IN + 1 :]


def _tagged(frames: list[DataFrame], kind: str, wanted: str) -> list[DataFrame]:
    """The rows of that kind of the sampled sweeps, in their order, with the wanted columns."""
    others = {c: F.lit(None).cast("binary") for c in "abcde" if c not in wanted}
    return [
        _kind(frame, kind).withColumns({"source": F.lit(i).cast("long"), **others})
        for i, frame in enumerate(frames)
    ]


def sampled_tables(key, table):
    """Tables of the entries that each cell sent, summed over the sampled sweeps."""
    rows = _rows(table)
    tables = sum(_ints(r["a"]) for r in rows["seats"])
    return pa.Table.from_pylist([
        {"kind": "tables", "place": r["source"], "source": key[0].as_py(),
         "a": pack(tables[_ints(r["a"])].astype(np.uint64))}
        for r in rows["seat"]
    ], _SCHEMA)


def answer_entries(shared: Restaurants):
    """What the customers of each asked entry weigh, summed over the sampled sweeps."""

    def run(key, table):
        rows = _rows(table)
        customers = np.zeros(0, np.int64)
        if "counts" in rows:
            customers = _ints(rows["counts"][0]["a"], np.uint64)
        tables = np.full(len(customers), SAMPLES, np.int64)
        tables[customers > 1] = _joined(
            [_ints(r["a"], np.uint64) for r in rows.get("tables", [])], np.int64
        )
        own = np.maximum(SAMPLES * customers - shared.discounts[0] * tables, 0.0)
        own = np.concatenate([[0.0], own]).astype(np.float32)
        return pa.Table.from_pylist([
            {"kind": "entries", "place": key[0].as_py(), "source": r["source"],
             "a": pack(own[_ints(r["a"])])}
            for r in rows.get("index", [])
        ], _SCHEMA)

    return run


def answer_words(shared: Restaurants):
    """For each asked word how often it is in training documents, its probability in the root and its
    tables as a context in each sampled sweep."""

    def run(key, table):
        rows = _rows(table)
        none = np.zeros(0, np.int64)
        words, counts = none.view(np.uint64), none
        roots = [(none, none)] * SAMPLES
        if "bucket" in rows:
            bucket = read_bucket(rows["bucket"][0])
            words, counts = bucket.words, bucket.counts
            roots = [(_ints(r["c"], np.uint64), _ints(r["d"], np.uint64)) for r in rows["seats"]]
        contexts, totals = none.view(np.uint64), [none] * SAMPLES
        if "context" in rows:
            contexts = unpack_sorted(rows["context"][0]["a"], np.uint64)
            totals = [_ints(r["a"], np.uint64) for r in rows["total"]]
        discount = shared.discounts[1]
        base = []
        for (customers, tables), history in zip(roots, shared.swept[BURN_IN + 1 :], strict=True):
            own = np.append(np.maximum(customers - discount * tables, 0.0), 0.0)
            spare = (ROOT_STRENGTH + discount * history[2]) / (shared.words + 1)
            base.append((own + spare) / (ROOT_STRENGTH + history[1]))
        found = []
        for r in rows.get("ask", []):
            asked = unpack_sorted(r["a"], np.uint64)
            word, context = _places(words, asked), _places(contexts, asked)
            found.append({
                "kind": "words", "place": key[0].as_py(), "source": r["source"],
                "a": pack(np.append(counts, 0)[word].astype(np.uint64)),
                "b": pack(np.concatenate([b[word] for b in base]).astype(np.float32)),
                "c": pack(np.concatenate(
                    [np.append(t, 0)[context] for t in totals]
                ).astype(np.uint64)),
            })
        return pa.Table.from_pylist(found, _SCHEMA)

    return run


def _places(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each asked value stands among ascending ones; the number of them if nowhere."""
    place = np.searchsorted(known, asked)
    inside = place < len(known)
    inside[inside] = known[place[inside]] == asked[inside]
    return np.where(inside, place, len(known))


def probabilities(
    answers: dict[str, list[dict]], home: np.ndarray, context: np.ndarray, shared: Restaurants
) -> tuple[np.ndarray, np.ndarray]:
    """How often training documents have each word of a block, and the average probability of each
    entry, from the answers in the order of their places."""
    own = np.concatenate([unpack(r["a"], np.float32) for r in answers["entries"]])
    own = own.astype(np.float64)
    count = np.concatenate([_ints(r["a"], np.uint64) for r in answers["words"]])
    base, tables = (
        np.concatenate(
            [unpack(r[name], dtype).reshape(SAMPLES, -1) for r in answers["words"]], axis=1
        ).astype(np.float64)
        for name, dtype in (("b", np.float32), ("c", np.uint64))
    )
    for of_word, of_context in zip(base, tables, strict=True):
        own += (CONTEXT_STRENGTH + shared.discounts[0] * of_context)[context] * of_word[home]
    # whoever follows a word sits in its restaurant, so it has as many customers as occurrences
    return count, own / (CONTEXT_STRENGTH + count[context]) / SAMPLES


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, train_rows: Column, doc_id: str = "doc_id", text: str = "text"):
    """`doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` for every
    row; the model learns from rows for which `train_rows` is true (null: false).

    Texts are taken whole, A-Z as a-z; a null text is empty and has one token, its end.  Words that
    no training row has share the mass of new words as one of `words + 1` equal parts.  Without any
    training token all probabilities are those of the empty root.  Equal rows count and are scored
    each for itself.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
        F.coalesce(train_rows, F.lit(False)).alias("train"),
    )
    counted = stored_alone(word_counts(rows, "train"), "word-counts")
    sums = counted.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    all_tokens, all_words = sums.n or 0, sums.v
    # at most 1 / HOT_SHARE words have this share
    frequent = counted.where(F.col("n") >= F.lit(max(all_tokens * HOT_SHARE, 1.0))).collect()
    hot = np.sort(np.array([r.word for r in frequent], np.int64).view(np.uint64))
    drop_stored(counted)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells, buckets = -(-size // CELL_BYTES) or 1, -(-size // BUCKET_BYTES) or 1

    blocks = stored_alone(block_rows(rows, "train"), "lm-blocks")
    merged = _step([asked(blocks, entry_rows, hot, cells)], merge_cells(buckets), "lm-cells")
    words = _step([_kind(merged, "busy")], make_buckets(buckets), "lm-buckets")
    contexts = _step(
        [_kind(merged, "single"), _kind(words, "link")], make_contexts, "lm-contexts"
    )
    none = np.zeros(0)
    shared = Restaurants(all_words, all_tokens, none, none)
    seats, totals = train(words, contexts, shared, buckets)

    # each answer is written before the next one is asked for, so that the rows behind it can go
    tables = _step(
        [_kind(words, "seat"), *_tagged(seats, "seats", "a")], sampled_tables, "lm-tables"
    )
    of_words = _step(
        [asked(blocks, word_rows, buckets), _kind(words, "bucket"),
         *_tagged(seats, "seats", "cd"), _kind(contexts, "context"),
         *_tagged(totals, "total", "a")],
        answer_words(shared), "lm-words", compressed=True,
    )
    drop_stored(words, contexts, *seats, *totals)
    of_entries = _step(
        [_kind(merged, "index", "counts"), tables], answer_entries(shared), "lm-entries",
        compressed=True,
    )
    drop_stored(merged, tables)

    def total(key, left, right):
        """Sums over the tokens of each document."""
        answers: dict[str, list[dict]] = {}
        for r in sorted(right.to_pylist(), key=lambda r: r["place"]):
            answers.setdefault(r["kind"], []).append(loosened(r))
        row = loosened(left.to_pylist()[0])
        held_words, word, sizes = _block(row)
        index, home, context, _ = arrange(held_words, word, sizes, hot, cells)
        count, chance = probabilities(answers, home, context, shared)
        log = np.log10(chance)[index]
        alone = np.log10((count + 1) / (all_tokens + all_words + 1))[word]
        first = np.cumsum(sizes) - sizes
        ids = unpack(row["docs"][: 8 * len(sizes)], np.int64)
        missing = unpack(row["docs"][8 * len(sizes) :], np.uint8).astype(bool)
        del answers, left, right
        give_back()
        return pa.Table.from_pydict({
            "doc_id": pa.array(ids, mask=missing),
            "held_out": pa.array(unpack(row["held"], np.uint8).astype(bool)),
            "n_tokens": pa.array(sizes),
            "n_known": pa.array(np.add.reduceat((count > 0)[word].astype(np.int64), first)),
            "base_score": pa.array(np.add.reduceat(alone, first)),
            "score": pa.array(np.add.reduceat(log, first)),
        })

    answers = of_entries.unionByName(of_words).withColumnRenamed("source", "block")
    answers = answers.select("block", "kind", "place", "a", "b", "c")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, SCORES)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(all_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
