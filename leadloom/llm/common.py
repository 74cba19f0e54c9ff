"""What the operators share: stored intermediates, text buffers, word hashes, hash mixing."""

from __future__ import annotations

import ctypes
import mmap
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import shared_folder

# The odd multipliers of the splitmix64 finaliser and its increment.
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """`frame` written to the folder all executors share and read again: its lineage ends here."""
    folder = shared_folder(frame.sparkSession, purpose)
    frame.write.option("compression", "zstd").parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


# Spark's setting for removing the shuffle files of a query as soon as it ends
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_alone(frame: DataFrame, purpose: str) -> DataFrame:
    """As `stored`; the shuffle files that led there go at once, not when the driver's garbage is
    collected."""
    conf = frame.sparkSession.conf
    before = conf.get(_SHUFFLE_CLEANUP, None)
    conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        return stored(frame, purpose)
    finally:
        if before is None:
            conf.unset(_SHUFFLE_CLEANUP)
        else:
            conf.set(_SHUFFLE_CLEANUP, before)


def drop_stored(*frames: DataFrame) -> None:
    """Remove the files of frames from `stored` that nothing reads any more; they stay in a store that
    Arrow does not know."""
    for frame in frames:
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            with suppress(pa.ArrowInvalid, OSError):
                system, path = FileSystem.from_uri(folder)
                system.delete_dir(path)


def bucket_of(*columns: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the start of each (one more than rows).

    A null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # some versions keep a single chunk wrapped
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


# bytes between words when punctuation does not count: all ASCII but letters and digits
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def words_of(
    raw: np.ndarray, starts: np.ndarray, between: np.ndarray = _IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (bytes not `between`, by default other than space and 0x09-0x0D)
    and, for each text, the index of its first word; words never cross texts."""
    word = ~between[raw]
    first = word.copy()
    last = word.copy()
    if len(raw):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cuts = starts[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        first[cuts] = word[cuts]
        last[cuts - 1] = word[cuts - 1]
    begins = np.flatnonzero(first)
    return begins, np.flatnonzero(last) + 1, np.searchsorted(begins, starts)


def word_hashes(
    raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, step: int = 1 << 18
) -> np.ndarray:
    """A 64-bit hash of each word, A-Z read as a-z: bytes times position-dependent odd numbers,
    summed and scrambled.  Works through `step` words at a time."""
    found = np.empty(len(begins), np.uint64)
    powers = np.zeros(0, np.uint64)
    for i in range(0, len(begins), step):
        b, e = begins[i : i + step], ends[i : i + step]
        sizes = e - b
        if sizes.max() > len(powers):
            powers = mix(np.arange(2 * sizes.max(), dtype=np.uint64)) | np.uint64(1)
        heads = np.cumsum(sizes) - sizes
        inside = np.arange(sizes.sum()) - np.repeat(heads, sizes)
        letters = _LOWER[raw[np.repeat(b, sizes) + inside]].astype(np.uint64) + np.uint64(1)
        found[i : i + step] = np.add.reduceat(letters * powers[inside], heads) + sizes.astype(
            np.uint64
        )
    return mix(found)


def give_back(above: int = 256 << 20) -> None:
    """Return freed memory to the system if the worker holds more than `above` bytes.  Python workers
    outlive their tasks, and what they keep counts against the executor."""
    with suppress(OSError, AttributeError):  # only some systems tell, and one C library can do it
        with open("/proc/self/statm") as file:
            resident = int(file.read().split()[1]) * mmap.PAGESIZE
        if resident > above:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)


def pack(values: np.ndarray) -> bytes:
    """Numbers as byte planes: equal high bytes lie next to each other and compress well."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()


def unpack(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """As `pack`, of the steps between ascending unsigned numbers."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Stretches of ascending `keys` that belong to one bucket: buckets cut the range of hashes."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63)))
    for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
        yield int(bucket[a]), slice(a, b)


def blocks_of(
    batches: Iterator[pa.RecordBatch], text_place: int, size: int
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut to about `size` bytes of text, with the bytes and the start of each text."""
    for batch in batches:
        raw, starts = text_buffer(batch.column(text_place))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(starts, starts[row] + size, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield (batch.slice(row, end - row), raw[starts[row] : starts[end]],
                   starts[row : end + 1] - starts[row])
            row = end
