"""CSV rows whose cells hold line breaks, read from files that stay split.

Whether a line break ends a row depends on the quotes before it, back to the start of the file.  What
a block does to that is a function of two states, outside and inside quotes, which its task finds
without knowing what comes before.  A prefix scan over the blocks of each file composes these
functions and tells every block where it starts; its task then cuts its lines into rows, and the
pieces of the one row that may cross each border are put together in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CSV_NAMES = "*.[cC][sS][vV]"
QUOTE, NEXT_QUOTED = b'"', b',"'
# Beyond so many blocks, the table of their states is not broadcast.
BROADCAST_BLOCKS = 200_000
# Rows handed on at a time.
_BATCH_ROWS = 4096


def csv_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`file_path, file_modified, block_start, place, line` (its bytes) of all CSV files; places
    ascend within a block."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", CSV_NAMES)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_modification_time").alias("file_modified"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("place"),
            F.col("value").cast("binary").alias("line"),
        )
    )


def open_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line that starts inside one or outside.

    Only a quote at the start of a cell opens it; two quotes in a row stand for one; what follows the
    closing quote belongs to the cell up to the next comma.
    """
    at = 0
    if not inside:
        inside = line.startswith(QUOTE)
        at = int(inside)
    while True:
        if inside:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line.startswith(QUOTE, at + 1):
                at += 2
                continue
            inside = False
            at += 1
        at = line.find(NEXT_QUOTED, at)
        if at < 0:
            return False
        inside = True
        at += len(NEXT_QUOTED)


def block_maps(lines: DataFrame) -> DataFrame:
    """What each block with a quote does: `outside` and `inside`, the state behind it for either
    state before it, and `opened`, whether a line break is quoted in it if it starts outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, outside, inside, opened = None, False, True, False
        for batch in batches:
            files, starts, texts = (batch.column(i).to_pylist() for i in range(3))
            for file, start, line in zip(files, starts, texts, strict=True):
                if (file, start) != block:
                    if block:
                        yield _map_row(block, outside, inside, opened)
                    block, outside, inside, opened = (file, start), False, True, False
                outside, inside = open_after(line, outside), open_after(line, inside)
                opened |= outside
        if block:
            yield _map_row(block, outside, inside, opened)

    quoted = lines.where(F.contains("line", F.lit(QUOTE)))
    return quoted.select("file_path", "block_start", "line").mapInArrow(
        run, "file_path string, block_start long, outside boolean, inside boolean, opened boolean"
    )


def _map_row(block: tuple[str, int], *states: bool) -> pa.RecordBatch:
    names = ["file_path", "block_start", "outside", "inside", "opened"]
    return pa.RecordBatch.from_pylist([dict(zip(names, (*block, *states), strict=True))])


def block_states(blocks: DataFrame, maps: DataFrame) -> DataFrame:
    """`blocks` (file_path, block_start) with `starts_inside` and `ends_inside`, and of their file
    `multi_line`, whether a line break is quoted in it.

    A block that leaves outside and inside apart keeps the state or swaps it; any other one sets it.
    So the state before a block is the one that the last setting block left, swapped as often as
    blocks have swapped since.
    """
    keys = ["file_path", "block_start"]
    known = blocks.select(*keys).join(maps, keys, "left").select(
        *keys, F.coalesce("outside", F.lit(False)).alias("outside"),
        F.coalesce("inside", F.lit(True)).alias("inside"),
        F.coalesce("opened", F.lit(False)).alias("opened"),
    )
    order = Window.partitionBy("file_path").orderBy("block_start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("outside") == F.col("inside")
    swaps = F.sum((F.col("outside") & ~F.col("inside")).cast("int"))
    counted = known.withColumns({
        "swaps": swaps.over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "swaps_before": F.coalesce(swaps.over(before), F.lit(0)),
    })
    last_set = F.last(
        F.when(sets, F.struct(F.col("outside").cast("int").alias("left"), "swaps")), ignorenulls=True
    ).over(before)
    since = F.col("swaps_before") - F.coalesce("last_set.swaps", F.lit(0))
    starts = (F.coalesce("last_set.left", F.lit(0)) + since) % 2 == 1
    placed = counted.withColumn("last_set", last_set).withColumn("starts_inside", starts)
    return placed.select(
        *keys, "starts_inside",
        F.when(F.col("starts_inside"), F.col("inside")).otherwise(F.col("outside"))
        .alias("ends_inside"),
        F.bool_or("opened").over(Window.partitionBy("file_path")).alias("multi_line"),
    )


def _pieces(lines: DataFrame) -> DataFrame:
    """Rows and parts of rows of each block (file_path, block_start, place, line, starts_inside; a
    block's lines in order, in one task): `kind` is `row` for a whole one, `header` for the first
    one of a file, `tail` for the start of a row that does not end in its block and `head` for what
    a block holds of a row that began before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        block = held = None
        for batch in batches:
            for file, start, place, line, inside in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                if (file, start) != block:
                    if held:
                        rows.append(held.part())
                    held = _Held(file, start, place, "head") if inside else None
                    block, header = (file, start), start == 0
                if held is None:
                    held = _Held(file, start, place, "row")
                if held.ends_with(line):
                    if held.kind == "head" or line.strip() or len(held.lines) > 1:
                        if header and held.kind == "row":
                            held.kind, header = "header", False
                        rows.append(held.whole())
                    held = None
            if len(rows) >= _BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=_PIECE)
                rows = []
        if held:
            rows.append(held.part())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_PIECE)

    return lines.select("file_path", "block_start", "place", "line", "starts_inside").mapInArrow(
        run, "file_path string, block_start long, row_seq long, kind string, record binary"
    )


_PIECE = pa.schema([
    ("file_path", pa.string()), ("block_start", pa.int64()), ("row_seq", pa.int64()),
    ("kind", pa.string()), ("record", pa.binary()),
])


class _Held:
    """Lines of the row that is being read."""

    def __init__(self, file: str, start: int, place: int, kind: str):
        self.at = {"file_path": file, "block_start": start, "row_seq": place}
        self.kind, self.inside, self.lines = kind, kind == "head", []

    def ends_with(self, line: bytes) -> bool:
        self.lines.append(line)
        if self.inside or QUOTE in line:
            self.inside = open_after(line, self.inside)
        return not self.inside

    def whole(self) -> dict:
        return {**self.at, "kind": self.kind, "record": b"\n".join(self.lines)}

    def part(self) -> dict:
        """What the block holds of a row that goes on in the next one."""
        if self.kind == "row":
            self.kind = "tail"
        return self.whole()


def records(lines: DataFrame, states: DataFrame, n_blocks: int, first_block: bool = False):
    """(headers, rows) of `lines` as `file_path, block_start, row_seq, record`; a row stands where
    it begins, and line breaks inside it are single line feeds.

    `states` names the blocks to read, `n_blocks` how many there are; lines of other blocks are left
    out.  With `first_block` only the start of each file is read.
    """
    if first_block:
        lines, states = (f.where(F.col("block_start") == 0) for f in (lines, states))
    keys = ["file_path", "block_start"]
    told = states.select(*keys, "starts_inside")
    if n_blocks <= BROADCAST_BLOCKS:
        placed = lines.join(F.broadcast(told), keys)
    else:  # the join moves lines, so each block is put in order again
        placed = lines.join(told, keys).sortWithinPartitions(*keys, "place")
    pieces = _pieces(placed)
    columns = ["file_path", "block_start", "row_seq", "record"]
    headers = pieces.where(F.col("kind") == "header").select(*columns)
    whole = pieces.where(F.col("kind") == "row").select(*columns)
    parts = pieces.where(F.col("kind").isin("tail", "head"))
    # a row that crosses borders: the last tail before a head began it; a head comes before the tail
    # of its own block
    order = Window.partitionBy("file_path").orderBy("block_start", "row_seq")
    began = F.last(
        F.when(F.col("kind") == "tail", F.struct("block_start", "row_seq")), ignorenulls=True
    ).over(order)
    crossing = (
        parts.withColumn("began", began)
        .groupBy("file_path", "began")
        .agg(F.array_sort(F.collect_list(F.struct("block_start", "row_seq", "record"))).alias("p"))
    )
    joined = F.array_join(F.transform("p", lambda p: F.hex(p["record"])), "0A")
    return headers, whole.unionByName(crossing.select(
        "file_path", "began.block_start", "began.row_seq", F.unhex(joined).alias("record")
    ))
