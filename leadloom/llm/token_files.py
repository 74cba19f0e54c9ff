"""Token counts of flat token files that carry no index.

A file is nothing but little-endian ids, each document closed by an end id.  Blocks of a file are
searched on their own; where a document runs over blocks, a prefix sum over the blocks stitches its
parts together.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.common import stored
from leadloom.llm.files import place, write_files
from leadloom.session import shared_folder

BLOCK_BYTES = 4 << 20
# Blocks whose sums are made in one window; the sums of such runs are then summed again.
BLOCKS_TO_RUN = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def write_token_files(
    docs: DataFrame, ranks_path: str, pattern: str, end_id: int, folder: str, text: str = "text"
) -> DataFrame:
    """Encode whole texts and write one flat file per task; the stored result lists, for each file,
    its documents in order (`path`, `number`, `doc_id`).  A null text is a document without tokens
    before its end id."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # one vocabulary
    width = np.dtype("<u2") if end_id < 1 << 16 else np.dtype("<u4")

    def write(batches: Iterator[pa.RecordBatch], create):
        encoding = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}
        )
        uri = stream = None
        number = 0
        for batch in batches:
            if stream is None:
                uri, stream = create()
            for value in batch.column(1).to_pylist():
                ids = encoding.encode_ordinary(value or "")
                stream.write(np.array([*ids, end_id], width).tobytes())
            yield uri, number, batch.num_rows, batch.column(0).to_pylist()
            number += batch.num_rows
        if stream is not None:
            stream.close()

    rows = write_files(
        docs.select("doc_id", text), folder, ".tokens", write,
        "path string, first long, records long, ids array<bigint>",
    )
    numbered = rows.select("path", "first", F.posexplode("ids").alias("place", "doc_id"))
    return stored(
        numbered.select("path", (F.col("first") + F.col("place")).alias("number"), "doc_id"),
        "token-files",
    )


def blocks(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of all files in `folder`; only names and sizes are read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    count = F.ceil(F.col("length") / block_bytes).cast("long")
    return files.where("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block")
    )


def scan_blocks(parts: DataFrame, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per block: number of ids, and the distance of every end id to the end id before it or, for the
    first, to the start of the block (`gaps`), and the ids behind the last end id (`tail`)."""
    width = np.dtype("<u2") if end_id < 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, block in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
                system, path = place(uri)
                with system.open_input_file(path) as file:
                    file.seek(block * block_bytes)
                    ids = np.frombuffer(file.read(block_bytes), width)
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_pydict({
                    "path": [uri],
                    "block": pa.array([block], pa.int64()),
                    "gaps": pa.array([np.diff(ends, prepend=-1) - 1], pa.list_(pa.int64())),
                    "tail": pa.array([len(ids) - 1 - (ends[-1] if len(ends) else -1)], pa.int64()),
                })

    tasks = parts.select("path", "block")
    spread = max(1, min(tasks.count(), 10_000))
    return tasks.repartition(spread, "path", "block").mapInArrow(
        run, "path string, block long, gaps array<bigint>, tail long"
    )


def documents_in_files(scanned: DataFrame) -> DataFrame:
    """One row per document of every file: `path`, `number` in the file, `n_tokens` without the end
    id.  Ids after the last end id of a file are an unfinished document and count too, if any.

    What a block must know of those before it are two sums: the documents closed so far, and the ids
    since the last end.  They are summed within runs of blocks and over the runs, so no file is
    walked by one task.
    """
    closed = F.size("gaps").cast("long")
    heads = scanned.select(
        "path", "block", "tail", closed.alias("closed"),
        F.floor(F.col("block") / BLOCKS_TO_RUN).alias("run"),
    )
    within = Window.partitionBy("path", "run").orderBy("block")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    summed = heads.select(
        "*",
        F.coalesce(F.sum("closed").over(before), F.lit(0)).alias("closed_before"),
        F.coalesce(F.sum("tail").over(before), F.lit(0)).alias("tails_before"),
    )
    # ids since the last end: all tails, less those before the last block that closes a document
    local = summed.withColumn(
        "mark", F.last(F.when(F.col("closed") > 0, F.col("tails_before")), True).over(before)
    ).withColumn("open_before", F.col("tails_before") - F.coalesce("mark", F.lit(0)))
    ends = heads.groupBy("path", "run").agg(
        F.sum("closed").alias("closed"),
        F.max(F.when(F.col("closed") > 0, F.col("block"))).alias("closing"),
        F.sum("tail").alias("tails"),
    )
    # tails from the last closing block of a run to its end
    open_end = (
        heads.join(ends.select("path", "run", "closing"), ["path", "run"])
        .where(F.col("closing").isNull() | (F.col("block") >= F.col("closing")))
        .groupBy("path", "run")
        .agg(F.sum("tail").alias("open_end"))
    )
    runs = ends.join(open_end, ["path", "run"])
    over = Window.partitionBy("path").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.select(
        "*",
        F.coalesce(F.sum("closed").over(over), F.lit(0)).alias("run_closed"),
        F.coalesce(F.sum("tails").over(over), F.lit(0)).alias("run_tails"),
    )
    # what lies before the last run that closes a document, and in it up to its last end
    spent = F.col("run_tails") + F.col("tails") - F.col("open_end")
    carried = sums.withColumn(
        "spent", F.last(F.when(F.col("closing").isNotNull(), spent), True).over(over)
    ).select(
        "path", "run", "run_closed",
        (F.col("run_tails") - F.coalesce("spent", F.lit(0))).alias("run_open"),
    )
    placed = local.join(carried, ["path", "run"]).select(
        "path", "block",
        (F.col("closed_before") + F.col("run_closed")).alias("documents"),
        (F.col("open_before") + F.when(F.col("mark").isNull(), F.col("run_open")).otherwise(0))
        .alias("open"),
    )
    # shuffled: gaps take many times the room of their files, by which Spark would broadcast them
    joined = scanned.join(placed.hint("merge"), ["path", "block"])
    found = joined.select(
        "path", "documents", "open", F.posexplode("gaps").alias("place", "gap")
    ).select(
        "path",
        (F.col("documents") + F.col("place")).alias("number"),
        (F.col("gap") + F.when(F.col("place") == 0, F.col("open")).otherwise(0)).alias("n_tokens"),
    )
    unfinished = (
        joined.groupBy("path").agg(F.max_by(F.struct(
            (F.col("documents") + F.size("gaps")).alias("number"),
            (F.col("tail") + F.when(F.size("gaps") == 0, F.col("open")).otherwise(0))
            .alias("n_tokens"),
        ), "block").alias("end"))
        .select("path", "end.number", "end.n_tokens")
        .where("n_tokens > 0")
    )
    return found.unionByName(unfinished)


def count_tokens(
    docs: DataFrame, ranks_path: str, pattern: str, end_id: int, folder: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Write `docs` as flat token files, scan them, and give each document its count: `doc_id`,
    `n_tokens`.  Rows of equal doc_id stay rows of their own."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    names = write_token_files(docs, ranks_path, pattern, end_id, folder)
    if names.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    # files of attempts that were not committed are not in the list of names
    listed = blocks(spark, folder, block_bytes).withColumn(
        "path", F.concat(F.lit(f"{folder}/"), F.regexp_extract("path", "[^/]+$", 0))
    ).join(names.select("path").distinct(), "path", "left_semi")
    scanned = stored(scan_blocks(listed, end_id, block_bytes), "token-blocks")
    # shuffled: the names' files hold each path once, rows in memory hold it each
    return documents_in_files(scanned).join(names.hint("merge"), ["path", "number"]).select(
        "doc_id", "n_tokens"
    )
