"""Files of the shared folder, written and read by tasks as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def place(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri)


def write_files(
    frame: DataFrame,
    folder: str,
    suffix: str,
    write: Callable[[Iterator[pa.RecordBatch], Callable], Iterator[tuple]],
    schema: str,
) -> DataFrame:
    """Let every task write files of its own.

    `write(batches, create)` gets the task's rows and `create()`, which opens a new file and returns
    (uri, stream); it yields rows of `schema`.  A task that runs twice writes other files; only
    those named by the rows that Spark commits count, so store the result before reading the files.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        def create():
            system, base = place(folder)
            system.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}{suffix}"
            return f"{folder}/{name}", system.open_output_stream(f"{base}/{name}")

        for row in write(batches, create):
            cells = [pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(cells, schema=arrow)

    return frame.mapInArrow(run, schema)

