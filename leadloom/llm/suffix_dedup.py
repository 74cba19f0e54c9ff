"""Repeated passages: bytes covered by a string of 50 bytes that an earlier document holds too.

Windows of 50 bytes are dealt out by their anchor: of the 24-byte strings in a window the one of
least hash, the leftmost of equals.  Equal windows have equal anchors, so they meet in one bucket.

1. Each block of documents lists its anchors; anchors that stand in one document only are done with.
2. Around each other anchor, blocks cut out the piece that holds its windows.  Each bucket sorts the
   suffixes of its pieces in two stages: suffixes smaller than their successor are sorted directly,
   the others are put in their places by one scan over the byte buckets.  Neighbours with a common
   prefix of 50 bytes are equal windows, and the least document of each group is known.
3. Each block removes what the buckets marked.

Blocks send every distinct anchor and piece once, so a passage in a third of all documents costs no
more than one row per block.  An anchor whose pieces differ, because a short phrase stands between
ever new neighbours, is wide beyond WIDE_PIECES of them: its windows go singly to the buckets of the
hashes of all their 50 bytes, where equal windows meet all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from leadloom.llm.common import (
    bucket_of,
    by_bucket,
    give_back,
    mix,
    pack,
    pack_sorted,
    text_buffer,
    unpack,
    unpack_sorted,
)

MATCH_BYTES = 50
ANCHOR_BYTES = 24
# Text of a block, and text whose anchors make a bucket.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 3 << 19
# Different pieces of an anchor, beside one per block, that may go to one bucket.
WIDE_PIECES = 4096
# Text that is looked at at once, so little that its hashes stay in a core's cache; positions in it
# take the low bits below the hash.
STEP = 1 << 16
PLACE = np.uint64((1 << 20) - 1)
_ODD = mix(np.arange(41, 45, dtype=np.uint64)) | np.uint64(1)
_ODDS = mix(np.arange(61, 72, dtype=np.uint64)) | np.uint64(1)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _words(raw: np.ndarray, at: int, count: int) -> np.ndarray:
    """The 8 bytes at each of `count` places from `at` on."""
    return np.ndarray((count,), "<u8", raw, at, (1,))


def anchor_runs(raw: np.ndarray, starts: np.ndarray) -> Runs:
    """Stretches of neighbouring windows with the same anchor: hash of the anchor, first window, and
    how many (at most MATCH_BYTES - ANCHOR_BYTES + 1)."""
    padded = np.concatenate([raw, np.zeros(64, np.uint8)])
    width = MATCH_BYTES - ANCHOR_BYTES + 1
    # the last window of the text at each place
    last = np.repeat((starts[1:] - MATCH_BYTES).astype(np.int32), np.diff(starts))
    keys, firsts, counts = [], [], []
    for at in range(0, len(raw), STEP):
        count = min(STEP, len(raw) - at)
        whole = min(count + width - 1, len(raw) - at)
        hashes = sum(
            _words(padded, at + 8 * j, whole) * _ODD[j] for j in range(ANCHOR_BYTES // 8)
        )
        hashes = (hashes ^ (hashes >> np.uint64(29))) * _ODD[3]
        hashes ^= hashes >> np.uint64(32)
        least = (hashes & ~PLACE) | np.arange(whole, dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - width + span], least[width - span :])
        place = (least[:count] & PLACE).astype(np.int64)
        real = at + np.flatnonzero(last[at : at + len(place)] >= np.arange(at, at + len(place)))
        if not len(real):
            continue
        chosen = place[real - at]
        fresh = np.flatnonzero(
            (np.diff(chosen, prepend=-1) != 0) | (np.diff(real, prepend=-2) != 1)
        )
        keys.append(hashes[chosen[fresh]])
        firsts.append(real[fresh])
        counts.append(np.diff(fresh, append=len(real)))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(counts)


def piece_hashes(raw: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of all bytes of the piece at each place."""
    words = _words(raw, 0, max(len(raw) - 7, 0))
    found = sizes.astype(np.uint64) * _ODDS[10]
    for j in range(-(-int(sizes.max(initial=0)) // 8)):
        found += words[firsts + np.minimum(8 * j, sizes - 8)] * _ODDS[j]
        found ^= found >> np.uint64(31)
    return mix(found)


def new_pieces(
    raw: np.ndarray, keys: np.ndarray, marks: np.ndarray, firsts: np.ndarray, sizes: np.ndarray
) -> np.ndarray:
    """Which of the pieces, in the order of keys and hashes, have other bytes than the one before."""
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1]) | (sizes[1:] != sizes[:-1])
    words = _words(raw, 0, max(len(raw) - 7, 0))
    alike = np.flatnonzero(~fresh)
    for j in range(-(-int(sizes[alike].max(initial=0)) // 8)):
        shift = np.minimum(8 * j, sizes[alike] - 8)
        other = words[firsts[alike] + shift] != words[firsts[alike - 1] + shift]
        fresh[alike[other]] = True
    return fresh


def block_anchors(ids: np.ndarray, raw, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors of a block, ascending, whether several documents hold them, and how many
    different pieces each has."""
    keys, firsts, counts = anchor_runs(raw, starts)
    docs = ids[np.searchsorted(starts, firsts, "right") - 1]
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    heads = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    if not len(heads):
        return keys, np.zeros(0, bool), np.zeros(0, np.uint32)
    several = np.minimum.reduceat(docs, heads) != np.maximum.reduceat(docs, heads)
    sizes = np.diff(heads, append=len(keys))
    pieces = np.ones(len(heads), np.uint32)
    # only anchors that stand more than once can have different pieces
    often = np.repeat(sizes > 1, sizes)
    chosen, home = order[often], np.repeat(np.arange(len(heads)), sizes)[often]
    marks = piece_hashes(raw, firsts[chosen], counts[chosen] + MATCH_BYTES - 1)
    by_mark = np.lexsort((marks, home))
    marks, home = marks[by_mark], home[by_mark]
    fresh = np.ones(len(home), bool)
    fresh[1:] = (home[1:] != home[:-1]) | (marks[1:] != marks[:-1])
    pieces[sizes > 1] = np.bincount(home[fresh], minlength=len(heads))[sizes > 1]
    return keys[heads], several, pieces


def single_windows(
    raw: np.ndarray, keys: np.ndarray, firsts: np.ndarray, counts: np.ndarray, wide: np.ndarray
) -> Runs:
    """The runs with those that are `wide` taken apart into runs of one window, whose keys are hashes
    of the whole window."""
    heads = np.cumsum(counts[wide]) - counts[wide]
    inside = np.arange(counts[wide].sum()) - np.repeat(heads, counts[wide])
    windows = np.repeat(firsts[wide], counts[wide]) + inside
    hashes = piece_hashes(raw, windows, np.full(len(windows), MATCH_BYTES))
    return (
        np.concatenate([keys[~wide], hashes]), np.concatenate([firsts[~wide], windows]),
        np.concatenate([counts[~wide], np.ones(len(windows), counts.dtype)]),
    )


def direct_order(padded: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The places `first` of a text of `n` bytes in the order of the 56 bytes that begin there: by the
    first 8, then those that are still equal by the next few, which share a number with the rank."""
    column = _words(padded, 0, n)[first].byteswap()
    order = np.argsort(column)
    first, column = first[order], column[order]
    fresh = np.ones(len(first), bool)
    fresh[1:] = column[1:] != column[:-1]
    tied = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
    at = 8
    while at < 56 and len(tied):
        own = first[tied]
        rank = np.cumsum(fresh[tied]).astype(np.uint64)
        taken = min((64 - int(rank[-1]).bit_length()) // 8, 56 - at)
        column = _words(padded, at, n)[own].byteswap() >> np.uint64(64 - 8 * taken)
        column |= rank << np.uint64(8 * taken)
        order = np.argsort(column)
        first[tied], column = own[order], column[order]
        fresh[tied[1:]] = column[1:] != column[:-1]
        tied = tied[~fresh[tied] | ~np.append(fresh[tied[1:]], True)]
        at += taken
    return first


def suffix_order(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The `wanted` places of `text` (a mask) in the order of the suffixes that begin there, as far
    as their first 56 bytes tell.

    Two stages: a suffix smaller than the next one is sorted directly; a larger one comes before all
    smaller ones of its first byte, in the order of the suffixes that follow.  Only suffixes that
    are wanted, or that decide the place of a wanted one, are looked at.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(72, np.uint8)])
    step = np.diff(padded[: n + 1].astype(np.int16))
    every = np.arange(n, dtype=np.int32)  # text of a bucket is far below 2 GB
    # among equal bytes the next change decides
    change = np.where(step != 0, every, np.int32(n - 1))
    change = np.minimum.accumulate(change[::-1])[::-1]
    larger = step[change] < 0
    direct = np.where(larger, np.int32(n - 1), every)
    direct = np.minimum.accumulate(direct[::-1])[::-1]
    del change, every
    # from a wanted place to the next one that is sorted directly
    marks = np.zeros(n + 1, np.int32)
    edges = np.flatnonzero(np.diff(wanted.astype(np.int8), prepend=0, append=0))
    np.add.at(marks, edges[::2], 1)
    np.add.at(marks, direct[edges[1::2] - 1] + 1, -1)
    needed = np.cumsum(marks[:n], dtype=np.int32) > 0
    del direct, marks

    first = direct_order(padded, np.flatnonzero(needed & ~larger).astype(np.int32), n)
    limits = np.searchsorted(text[first], np.arange(256, dtype=np.uint8)).tolist()
    limits.append(len(first))

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if larger[n - 1] and needed[n - 1]:  # the end of the text comes before all of it
        waiting[text[n - 1]].append(np.array([n - 1], np.int32))
    ordered = []
    for byte in range(256):
        row = waiting[byte]
        newest = np.concatenate(row) if row else np.zeros(0, np.int32)
        while len(newest):  # runs of the same byte
            before = newest[newest > 0] - 1
            newest = before[(text[before] == byte) & larger[before] & needed[before]]
            row.append(newest)
        row.append(first[limits[byte] : limits[byte + 1]])
        done = np.concatenate(row)
        ordered.append(done)
        before = done[done > 0] - 1
        before = before[larger[before] & needed[before] & (text[before] > byte)]
        before = before[np.argsort(text[before], kind="stable")]
        sizes = np.bincount(text[before], minlength=256)
        ends = np.cumsum(sizes)
        for larger_byte in np.flatnonzero(sizes):
            end = ends[larger_byte]
            waiting[larger_byte].append(before[end - sizes[larger_byte] : end])
        waiting[byte] = []
    places = np.concatenate(ordered)
    return places[wanted[places]]


def common_prefixes(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Bytes, up to MATCH_BYTES, that the suffix at each place shares with the one before it."""
    padded = np.concatenate([text, np.zeros(72, np.uint8)])
    shared = np.zeros(len(places), np.int64)
    alike = np.ones(max(len(places) - 1, 0), bool)
    for j in range(0, MATCH_BYTES, 8):
        column = _words(padded, j, len(text))[places]
        differ = column[1:] ^ column[:-1]
        low = differ & (~differ + np.uint64(1))  # the lowest set bit is in the first other byte
        equal = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        shared[1:] += np.where(alike, equal, 0)
        alike &= differ == 0
    return np.minimum(shared, MATCH_BYTES)


def least_documents(pieces: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For every window of every (distinct) piece, the least document that holds it; `docs` is the
    least document of each piece."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    counts = sizes - MATCH_BYTES + 1
    edges = np.zeros(len(text) + 1, np.int8)
    edges[ends - sizes] += 1
    edges[ends - sizes + counts] -= 1
    wanted = np.cumsum(edges[:-1], dtype=np.int8) > 0
    places = suffix_order(text, wanted)
    heads = np.flatnonzero(common_prefixes(text, places) < MATCH_BYTES)
    owner = docs[np.searchsorted(ends, places, "right")]
    least = np.minimum.reduceat(owner, heads)
    found = np.empty(len(text), np.int64)
    found[places] = np.repeat(least, np.diff(heads, append=len(places)))
    return [found[e - s : e - s + c] for e, s, c in zip(ends, sizes, counts, strict=True)]


def widen(gone: np.ndarray, raw: np.ndarray, starts: np.ndarray) -> None:
    """Let the runs of `gone` begin and end between characters, none in another text."""
    if not len(gone):
        return
    edges = np.flatnonzero(gone[1:] != gone[:-1]) + 1
    heads, tails = edges[gone[edges]], edges[~gone[edges]]

    def inside(places: np.ndarray) -> np.ndarray:
        """Those places that do not begin a character."""
        return places[((raw[places] & 0xC0) == 0x80) & ~np.isin(places, starts)]

    for _ in range(3):  # a character has four bytes at most
        heads = inside(heads) - 1
        gone[heads] = True
        tails = inside(tails)
        gone[tails] = True
        tails = tails[tails + 1 < len(raw)] + 1


def _rows(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches():
        yield from batch.to_pylist()


def _table(rows: list[dict], types: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema(types))


ANCHORS = [("block", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()),
           ("several", pa.binary()), ("pieces", pa.binary())]
SHARED = [("block", pa.int32()), ("bucket", pa.int32()), ("marks", pa.binary()),
          ("wide", pa.binary()), ("masks", pa.binary())]
PIECES = [("block", pa.int32()), ("bucket", pa.int32()), ("sizes", pa.binary()),
          ("text", pa.binary()), ("docs", pa.binary())]


def _ddl(types: list[tuple]) -> str:
    return ", ".join(f"{n} {'int' if t == pa.int32() else 'binary'}" for n, t in types)


def removed_bytes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
    wide_pieces: int = WIDE_PIECES, whole_characters: bool = False,
) -> DataFrame:
    """`docs` with `removed` (first byte and byte behind the last of each maximal removed run) and
    `kept` (the remaining bytes), replacing columns of these names.

    A byte goes if it lies in a string of 50 bytes that also begins in a document of smaller id, in
    the input.  A null text counts as empty.  Rows of equal id are no reason to remove from each
    other; rows without an id lose nothing and are no reason either.  `kept` is bytes because a run
    may begin inside a character; with `whole_characters` a character that loses a byte goes whole.
    """
    docs = docs.drop("removed", "kept")
    names = docs.columns
    with_id = docs.where(F.col(doc_id).isNotNull())
    size = with_id.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, buckets = -(-size // block_bytes) or 1, -(-size // bucket_bytes) or 1
    block = "_block"
    while block.lower() in map(str.lower, names):
        block += "_"
    grouped = with_id.withColumn(block, bucket_of(doc_id, buckets=blocks)).groupBy(block)
    id_place, text_place = names.index(doc_id), names.index(text)

    def in_order(table: pa.Table) -> pa.Table:
        """Rows of a block come in any order; pieces are numbered alike in all steps."""
        keys = pa.table({"i": table.column(id_place), "t": table.column(text_place)})
        return table.take(pc.sort_indices(keys, [("i", "ascending"), ("t", "ascending")]))

    def block_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw, starts = text_buffer(table.column(text_place))
        return table.column(id_place).to_numpy().astype(np.int64), raw, starts

    def send_anchors(key, table):
        keys, several, pieces = block_anchors(*block_of(in_order(table)))
        return _table([
            {"block": key[0].as_py(), "bucket": bucket, "keys": pack_sorted(keys[part]),
             "several": np.packbits(several[part]).tobytes(), "pieces": pack(pieces[part])}
            for bucket, part in by_bucket(keys, buckets)
        ], ANCHORS)

    def find_shared(key, table):
        rows = list(_rows(table))
        lists = [unpack_sorted(r["keys"], np.uint64) for r in rows]
        several = [
            np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(k)).astype(bool)
            for r, k in zip(rows, lists, strict=True)
        ]
        keys = np.concatenate(lists)
        order = np.argsort(keys, kind="stable")
        heads = np.flatnonzero(np.diff(keys[order], prepend=~keys[order][:1]))
        sizes = np.diff(heads, append=len(keys))
        shared = np.logical_or.reduceat(np.concatenate(several)[order], heads) | (sizes > 1)
        marks = np.empty(len(keys), bool)
        marks[order] = np.repeat(shared, sizes)
        more = np.concatenate([unpack(r["pieces"], np.uint32) for r in rows]).astype(np.int64) - 1
        wide = np.empty(len(keys), bool)
        wide[order] = np.repeat(np.add.reduceat(more[order], heads) > wide_pieces, sizes)
        cuts = np.cumsum([0, *map(len, lists)])
        return _table([
            {"block": r["block"], "bucket": r["bucket"], "masks": None,
             "marks": np.packbits(marks[a:b]).tobytes(),
             "wide": np.packbits(wide[a:b]).tobytes() if wide[a:b].any() else None}
            for r, a, b in zip(rows, cuts, cuts[1:], strict=False) if marks[a:b].any()
        ], SHARED)

    def shared_runs(ids, raw, starts, told: list[dict]):
        """Runs around shared anchors, those of wide ones window by window, in the order of their
        keys and pieces: key, first window, windows and document of each; where a new piece begins,
        and the least document of each piece."""
        marks = {r["bucket"]: r for r in told if r["marks"] is not None}
        keys, firsts, counts = anchor_runs(raw, starts)
        every, index = np.unique(keys, return_inverse=True)
        shared, wide = np.zeros(len(every), bool), np.zeros(len(every), bool)
        for bucket, part in by_bucket(every, buckets):
            for name, bits in (("marks", shared), ("wide", wide)):
                if bucket in marks and marks[bucket][name] is not None:
                    found = np.frombuffer(marks[bucket][name], np.uint8)
                    bits[part] = np.unpackbits(found, count=part.stop - part.start)
        chosen = np.flatnonzero(shared[index])
        wide = wide[index[chosen]]
        keys, firsts, counts = keys[chosen], firsts[chosen], counts[chosen]
        if wide.any():
            keys, firsts, counts = single_windows(raw, keys, firsts, counts, wide)
        sizes = counts + MATCH_BYTES - 1
        marks = piece_hashes(raw, firsts, sizes)
        chosen = np.lexsort((marks, keys))
        keys, firsts, counts = keys[chosen], firsts[chosen], counts[chosen]
        fresh = new_pieces(raw, keys, marks[chosen], firsts, sizes[chosen])
        docs_of = ids[np.searchsorted(starts, firsts, "right") - 1]
        heads = np.flatnonzero(fresh)
        least = np.minimum.reduceat(docs_of, heads) if len(heads) else docs_of
        return keys, firsts, counts, docs_of, heads, least

    def send_pieces(key, left, right):
        rows = []
        if left.num_rows and right.num_rows:
            ids, raw, starts = block_of(in_order(left))
            keys, firsts, counts, _, heads, least = shared_runs(
                ids, raw, starts, list(_rows(right))
            )
            whole, begins = memoryview(raw), firsts[heads]
            sizes = counts[heads] + MATCH_BYTES - 1
            for bucket, part in by_bucket(keys[heads], buckets):
                spans = zip(begins[part].tolist(), sizes[part].tolist(), strict=True)
                rows.append({
                    "block": key[0].as_py(), "bucket": bucket,
                    "text": b"".join([whole[a : a + n] for a, n in spans]),
                    "sizes": pack(sizes[part].astype(np.uint8)), "docs": pack(least[part]),
                })
        return _table(rows, PIECES)

    def sort_pieces(key, table):
        give_back()  # what earlier steps left in this worker
        rows = list(_rows(table))
        places: dict[bytes, int] = {}
        members, least = [], []
        for row in rows:
            ends = np.cumsum(unpack(row["sizes"], np.uint8).astype(np.int64)).tolist()
            text = row["text"]
            members.append(np.array([
                places.setdefault(text[a:b], len(places))
                for a, b in zip([0, *ends], ends, strict=False)
            ]))
            least.append(unpack(row["docs"], np.int64))
            row["text"] = None
        pa.default_memory_pool().release_unused()
        docs = np.full(len(places), np.iinfo(np.int64).max)
        for which, own in zip(members, least, strict=True):
            np.minimum.at(docs, which, own)
        pieces = list(places)
        of_windows = least_documents(pieces, docs)
        counts = np.array([len(w) for w in of_windows])
        begins = np.cumsum(counts) - counts
        flat = np.concatenate(of_windows)
        found = []
        for row, which, own in zip(rows, members, least, strict=True):
            # bit j of a mask: window j also begins in a document before the block's own least
            sizes = counts[which]
            heads = np.cumsum(sizes) - sizes
            inside = np.arange(sizes.sum()) - np.repeat(heads, sizes)
            earlier = flat[np.repeat(begins[which], sizes) + inside] < np.repeat(own, sizes)
            bits = earlier.astype(np.uint32) << inside.astype(np.uint32)
            found.append({
                "block": row["block"], "bucket": row["bucket"], "marks": None, "wide": None,
                "masks": pack(np.add.reduceat(bits, heads).astype(np.uint32)),
            })
        return _table(found, SHARED)

    runs = T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ]))
    schema = T.StructType([
        *docs.schema.fields,
        T.StructField("removed", runs), T.StructField("kept", T.BinaryType()),
    ])
    arrow_runs = to_arrow_type(runs)

    def cut(key, left, right):
        left = in_order(left)
        ids, raw, starts = block_of(left)
        told = list(_rows(right))
        masks = {r["bucket"]: r["masks"] for r in told if r["masks"] is not None}
        hit = np.zeros(len(raw), bool)  # windows that go
        if masks:
            keys, firsts, counts, docs_of, heads, least = shared_runs(ids, raw, starts, told)
            which = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(keys)))
            mask = np.concatenate([
                unpack(masks[bucket], np.uint32) for bucket, _ in by_bucket(keys[heads], buckets)
            ])[which]
            # beside earlier documents elsewhere, the least one of this block comes first
            every = (np.uint64(1) << counts.astype(np.uint64)) - np.uint64(1)
            mask = np.where(docs_of > least[which], every.astype(np.uint32), mask)
            for j in range(MATCH_BYTES - ANCHOR_BYTES + 1):
                hit[firsts[(mask >> np.uint32(j)) & np.uint32(1) == 1] + j] = True
        before = np.cumsum(hit, dtype=np.int32)
        gone = before > 0
        gone[MATCH_BYTES:] = before[MATCH_BYTES:] > before[:-MATCH_BYTES]
        del before, hit
        if whole_characters:
            widen(gone, raw, starts)
        return with_cuts(left, raw, starts, gone)

    def with_cuts(left: pa.Table, raw, starts, gone: np.ndarray) -> pa.Table:
        """Runs never cross texts: windows lie inside theirs, and texts are cut apart here."""
        edge = np.diff(gone.astype(np.int8), prepend=0) == 1
        stop = np.diff(gone.astype(np.int8), append=0) == -1
        inner = starts[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        across = inner[gone[inner] & gone[inner - 1]]
        edge[across] = True
        stop[across - 1] = True
        begin, end = np.flatnonzero(edge), np.flatnonzero(stop) + 1
        home = np.searchsorted(starts, begin, "right") - 1
        sizes = np.searchsorted(home, np.arange(len(starts)))
        spans = pa.StructArray.from_arrays(
            [pa.array(begin - starts[home]), pa.array(end - starts[home])], ["start", "end"]
        )
        del edge, stop
        kept = raw[~gone]
        lost = np.zeros(len(starts), np.int64)
        np.add.at(lost, home + 1, end - begin)
        offsets = (starts - np.cumsum(lost)).astype(np.int32)
        binary = pa.Array.from_buffers(
            pa.binary(), len(starts) - 1,
            [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))],
        )
        removed = pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), spans)
        removed = removed.cast(arrow_runs)
        columns = [left.column(i) for i in range(len(names))]
        return pa.Table.from_arrays([*columns, removed, binary], [*names, "removed", "kept"])

    anchors = grouped.applyInArrow(send_anchors, _ddl(ANCHORS))
    shared = anchors.groupBy("bucket").applyInArrow(find_shared, _ddl(SHARED))
    pieces = grouped.cogroup(shared.groupBy("block")).applyInArrow(send_pieces, _ddl(PIECES))
    marked = pieces.groupBy("bucket").applyInArrow(sort_pieces, _ddl(SHARED))
    told = shared.unionByName(marked)
    whole = grouped.cogroup(told.groupBy("block")).applyInArrow(cut, schema)
    untouched = docs.where(F.col(doc_id).isNull()).select(
        "*",
        F.from_json(F.lit("[]"), runs).alias("removed"),
        F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("kept"),
    )
    return whole.unionByName(untouched)


def digests(cut: DataFrame, text: str = "text") -> DataFrame:
    """Per document: bytes, bytes and runs removed, digest of what is left."""
    length = F.aggregate(
        "removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]
    )
    return cut.select(
        "doc_id",
        F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"),
        length.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` with the repeated bytes taken out of `text`.  What is left of a character that was cut
    through goes too; all other characters stay as they are."""
    cut = removed_bytes(docs, text, whole_characters=True, **options)
    clean = F.when(F.size("removed") > 0, F.col("kept").cast("string")).otherwise(F.col(text))
    return cut.withColumn(text, clean).select(*docs.columns)
