"""Uploaded contact files: guard, dialect scan, CSV and workbook reading."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leadloom.constants import UPLOAD_EXTENSIONS
from leadloom.operators.columns import PLAN_TYPE, field_places, plan_mapping, resolve_cells
from leadloom.operators.ingest import append_files
from leadloom.session import shared_folder
from leadloom.sources.records import CSV_NAMES, block_maps, block_states, csv_lines, records

# Where a row stood: its file, the start of its split, its position in the split.  Files come in path
# order, or in the order they were uploaded.
ROW_ORDER = ["file_path", "block_start", "row_seq"]
UPLOAD_ORDER = ["file_modified", *ROW_ORDER]
FILE_COLUMNS = ["source_file", *UPLOAD_ORDER]

MAPPING_TYPE = "map<string,string>"

# Byte values that Windows-1252 and Latin-1 read differently; five of them are undefined in the
# former, and a file that holds one is Latin-1.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_UNDEFINED = "".join(ch for ch in _C1 if not ch.encode("latin-1").decode("cp1252", "ignore"))
_CP1252_FROM = "".join(ch for ch in _C1 if ch not in _UNDEFINED)
_CP1252_TO = _CP1252_FROM.encode("latin-1").decode("cp1252")


def plain_file_name(path: str) -> Column:
    """Last part of a file address, its escapes undone."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def readable_path(address: str) -> str:
    """The path to read a file by: escapes of its address undone, letters of patterns escaped."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(address))


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`path, filename, length, verdict` of every file; contents are not read.  No file is refused
    for its size: CSV files are split among tasks, and a workbook is one task's work."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length")
        .withColumn("filename", F.regexp_extract("path", "([^/]*)$", 1))
    )
    extension = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    return files.withColumn(
        "verdict",
        F.when(~extension.isin(*UPLOAD_EXTENSIONS), "extension")
        .when(extension == ".xls", "unsupported")
        .otherwise("accepted"),
    )


def rejected_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return list_files(spark, path).where(F.col("verdict") != "accepted")


def csv_blocks(lines: DataFrame) -> DataFrame:
    """One row per block of a CSV file (`file_path`, `block_start`): its first filled line if the file
    begins with it, whether its lines are UTF-8, hold a byte that Windows-1252 lacks, or a quote.

    Lines are tested where they are read and combined per block before the shuffle, so no file is
    loaded whole.
    """
    read = lines.select(
        "file_path", "file_modified", "block_start", "place",
        F.is_valid_utf8(F.col("line").cast("string")).alias("valid"),
        F.decode("line", "ISO-8859-1").alias("latin"), "line",
    )
    opening = (F.col("block_start") == 0) & (F.trim("latin") != "")
    return read.groupBy("file_path", "block_start").agg(
        F.max("file_modified").alias("file_modified"),
        F.min_by("line", F.when(opening, F.col("place"))).alias("header"),
        F.bool_and("valid").alias("valid"),
        F.bool_or(~F.col("valid") & F.col("latin").rlike(f"[{_UNDEFINED}]")).alias("undefined"),
        F.bool_or(F.contains("latin", F.lit('"'))).alias("quoted"),
    )


def csv_dialects(blocks: DataFrame) -> DataFrame:
    """`file_path, file_modified, header, encoding` per CSV file that holds a line, from its blocks.

    A file is UTF-8 if all its lines are, else Windows-1252, else Latin-1.
    """
    files = blocks.groupBy("file_path").agg(
        F.max("file_modified").alias("file_modified"),
        F.min_by("header", "block_start").alias("header"),
        F.bool_and("valid").alias("valid"),
        F.bool_or("undefined").alias("undefined"),
    )
    return files.select(
        "file_path", "file_modified", _header_text("header").alias("header"),
        F.when(F.col("valid"), "utf-8").when(F.col("undefined"), "latin-1").otherwise("cp1252")
        .alias("encoding"),
    )


def _header_text(line: str) -> Column:
    text = F.col(line).cast("string")
    shown = F.when(F.is_valid_utf8(text), text).otherwise(F.decode(line, "ISO-8859-1"))
    return F.regexp_replace(shown, r"^\x{FEFF}|^ï»¿|\r$", "")


def unique_headers(headers: list[str]) -> list[str]:
    """Repeated headers get the first free one of `.1`, `.2`, ...; empty ones a running name."""
    named = [header or f"Unnamed: {i}" for i, header in enumerate(headers)]
    taken = set(named)
    used: set[str] = set()
    counts: dict[str, int] = {}
    out = []
    for header in named:
        name = header
        while name in used:
            counts[header] = counts.get(header, 0) + 1
            name = f"{header}.{counts[header]}"
            if name in taken:
                name = header
        used.add(name)
        out.append(name)
    return out


def split_header(line: str) -> list[str]:
    """Cells of a header line, quotes honoured."""
    cells = re.findall(r'(?:^|,)(?:"((?:[^"]|"")*)"|([^,]*))', line)
    return [quoted.replace('""', '"') if quoted else plain for quoted, plain in cells]


def header_plan(headers: list[str], external: object = None) -> dict | None:
    """What the cells of a file mean by place: names, places per field, last first, and the places
    that belong to no field.  None without an e-mail column."""
    names = unique_headers(headers)
    try:
        mapping = plan_mapping(names, external)
    except ValueError:
        return None
    places = field_places(names, mapping)
    mapped = {i for found in places.values() for i in found}
    return {
        "names": names, "places": places,
        "others": [i for i in range(len(names)) if i not in mapped],
    }


def read_csv_files(
    spark: SparkSession, path: str | list[str], external: object = None,
    tables: str | None = None, required: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, rejects) of all CSV files under `path`.

    All files are one splittable read whose columns are numbered; what a cell means comes from the
    table of file headers, joined by file, so a header can have any name and one file's header never
    names the columns of another.  That table is written once, to the folder `tables` or else to the
    shared folder.  `external` is a
    mapping {header: field} for files whose headers hold no e-mail column, or a table `source_file,
    mapping map<string,string>` with one for each file.  Line breaks may stand inside quotes, also
    in headers: files that have such are read by `records`, all others line by line.  Rejects carry
    a reason: a refused file, a file without an e-mail column or with a quote that is never closed
    (one row each), or a row with more cells than the header; a shorter row is filled up.  Without
    a usable file this raises an error, or with `required` off gives no rows.
    """
    tables = tables or shared_folder(spark, "uploads")
    lines = csv_lines(spark, path)
    blocks = _written(csv_blocks(lines), f"{tables}/blocks")
    found = blocks.agg(
        F.count("*").alias("blocks"), F.bool_or("quoted").alias("quoted")
    ).first()
    if required and not found.blocks:
        raise FileNotFoundError(f"no CSV files under {path}")
    dialects = csv_dialects(blocks)
    states = None
    if found.quoted:
        states = _written(block_states(blocks, block_maps(lines)), f"{tables}/block-states")
        shapes = states.groupBy("file_path").agg(
            F.bool_or("multi_line").alias("multi_line"),
            F.max_by("ends_inside", "block_start").alias("unclosed"),
        )
        if not shapes.where(F.col("multi_line")).limit(1).count():
            states = None
    if states is None:
        dialects = dialects.withColumns({"multi_line": F.lit(False), "unclosed": F.lit(False)})
    else:
        states = states.where(F.col("multi_line"))
        first, _ = records(lines, states, found.blocks, first_block=True)
        whole = first.select("file_path", _header_text("record").alias("whole"))
        dialects = dialects.join(shapes, "file_path").join(whole, "file_path", "left").withColumn(
            "header", F.coalesce("whole", "header")
        )
    files = _written(_planned(dialects, external), f"{tables}/dialects")
    readable = F.col("plan").isNotNull() & ~F.col("unclosed")
    counted = files.agg(
        F.count_if(readable).alias("usable"), F.max(F.size("plan.names")).alias("width"),
    ).first()
    if required and not counted.usable:
        raise ValueError(f"no email column in any file under {path}")
    width = counted.width or 0
    known = files.where(readable).select(
        "file_path", "file_modified", "encoding", "plan", "multi_line"
    )
    raw = _read_cells(spark, path, width).join(
        known.where(~F.col("multi_line")).drop("multi_line", "file_modified"), "file_path"
    )
    if states is not None:
        _, rows = records(lines, states, found.blocks)
        cut = rows.join(known.where("multi_line").drop("multi_line"), "file_path")
        raw = raw.unionByName(_record_cells(cut, width))
    beyond = F.slice("cells", F.size("plan.names") + 1, width + 1)
    too_long = F.exists(beyond, lambda c: c.isNotNull())
    reason = F.when(F.col("unclosed"), "unclosed quote").otherwise("no email column")
    rejects = append_files([
        raw.where(too_long).select(*FILE_COLUMNS, F.lit("too many cells").alias("reason")),
        files.where(~readable).select(
            plain_file_name("file_path").alias("source_file"), "file_path", reason.alias("reason"),
        ),
        _refused(spark, path),
    ])
    cells = F.transform("cells", lambda c: _decoded(c, F.col("encoding")))
    rows = raw.where(~too_long).withColumn("cells", cells)
    return resolve_cells(rows, FILE_COLUMNS), rejects


def _written(frame: DataFrame, folder: str) -> DataFrame:
    """A small table, written and read again."""
    frame.write.mode("overwrite").parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def _planned(files: DataFrame, external: object) -> DataFrame:
    """Files with what their header means: a small helper per file, not per row."""
    if isinstance(external, DataFrame):
        names = files.withColumn("source_file", plain_file_name("file_path"))
        files = names.join(external.select("source_file", "mapping"), "source_file", "left")
    else:
        mapping = F.lit(json.dumps(external)) if isinstance(external, dict) else F.lit(None)
        files = files.withColumn("mapping", F.from_json(mapping.cast("string"), MAPPING_TYPE))
    plan = F.udf(lambda line, mapping: header_plan(split_header(line or ""), mapping), PLAN_TYPE)
    return files.select(
        "file_path", "file_modified", "encoding", "multi_line", "unclosed",
        plan("header", "mapping").alias("plan")
    )


def _refused(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return rejected_files(spark, path).select(
        plain_file_name("path").alias("source_file"), F.col("path").alias("file_path"),
        F.col("verdict").alias("reason"),
    )


# How a line is cut into cells: quotes are doubled inside quotes, nothing else escapes.
_CELLS = {"escape": '"'}


def _cell_names(width: int) -> list[str]:
    """One more than the widest header has."""
    return [f"c{i}" for i in range(width + 1)]


def _read_cells(spark: SparkSession, path: str | list[str], width: int) -> DataFrame:
    """Position columns and `cells` of the lines of all files but their headers.

    Bytes are read as the letters of the same number: commas, quotes and line breaks are the same in
    all three encodings, and cells are decoded once their file is known."""
    names = _cell_names(width)
    rows = (
        spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
        .options(header=True, encoding="ISO-8859-1", **_CELLS)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", CSV_NAMES)
        .csv(path)
    )
    return rows.select(
        plain_file_name("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("file_modified"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_seq"),
        F.array(*names).alias("cells"),
    )


def _record_cells(rows: DataFrame, width: int) -> DataFrame:
    """The same of rows that were cut out of the files before, `record` being their bytes."""
    names = _cell_names(width)
    cells = F.from_csv(
        F.decode("record", "ISO-8859-1"), ", ".join(f"{n} string" for n in names), _CELLS
    )
    return rows.withColumn("parsed", cells).select(
        plain_file_name("file_path").alias("source_file"), "file_modified", "file_path",
        "block_start", "row_seq", F.array(*[f"parsed.{n}" for n in names]).alias("cells"),
        "encoding", "plan",
    )


def _decoded(cell: Column, encoding: Column) -> Column:
    return (
        F.when(encoding == "utf-8", F.decode(F.encode(cell, "ISO-8859-1"), "UTF-8"))
        .when(encoding == "cp1252", F.translate(cell, _CP1252_FROM, _CP1252_TO))
        .otherwise(cell)
    )


# --- workbooks -----------------------------------------------------------------------------------
# Names of the published workbook format.
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_SHEET_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

# Rows of a workbook handed on at a time.
_BATCH_ROWS = 4096


def read_workbook(content: bytes) -> list[list[str]]:
    """Cells of the first sheet as text, row by row, gaps as empty text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(_SHEET + "t")) for si in root]
        root = ElementTree.fromstring(book.read(_first_sheet(book, names)))
    return [_sheet_row(row, shared) for row in root.iter(_SHEET + "row")]


def _first_sheet(book: zipfile.ZipFile, names: set[str]) -> str:
    """The part that holds the sheet named first; without a list of sheets the lowest number."""
    links = "xl/_rels/workbook.xml.rels"
    if {"xl/workbook.xml", links} <= names:
        sheet = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_SHEET + "sheet"))
        for link in ElementTree.fromstring(book.read(links)):
            if link.get("Id") == sheet.get(_SHEET_ID):
                return posixpath.normpath(posixpath.join("/xl", link.get("Target"))).lstrip("/")
    sheets = (n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
    return min(sheets, key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))


def _sheet_row(row: ElementTree.Element, shared: list[str]) -> list[str]:
    cells: dict[int, str] = {}
    for position, cell in enumerate(row.iter(_SHEET + "c")):
        letters = re.match("[A-Z]+", cell.get("r", ""))
        column = _column_number(letters[0]) if letters else position
        kind, value = cell.get("t"), cell.findtext(_SHEET + "v") or ""
        if kind == "s":
            value = shared[int(value)]
        elif kind == "inlineStr":
            value = "".join(t.text or "" for t in cell.iter(_SHEET + "t"))
        elif kind is None and value.endswith(".0"):
            value = value[:-2]
        cells[column] = value
    return [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


def _column_number(letters: str) -> int:
    number = 0
    for letter in letters:
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def workbook_rows(
    spark: SparkSession, path: str | list[str], external: object = None
) -> DataFrame:
    """Position columns, `cells` and `plan` of all workbook rows, each workbook parsed by one task.
    A workbook without an e-mail column, or that cannot be read, is one row with a `reason`."""
    books = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[xX][lL][sS][xX]")
        .load(path)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.unix_micros("modificationTime").alias("modified"),
            "content",
        )
    )
    fields = "file_path string, modified bigint, row_seq bigint, cells array<string>"
    schema = T.DataType.fromDDL(f"{fields}, plan {PLAN_TYPE}, reason string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        for batch in batches:
            for name, modified, content in zip(*(c.to_pylist() for c in batch.columns)):
                known = {"file_path": name, "modified": modified}
                try:
                    sheet = read_workbook(content)
                except (KeyError, ValueError, StopIteration, zipfile.BadZipFile,
                        ElementTree.ParseError):
                    sheet, reason = [], "unreadable"
                else:
                    reason = None
                plan = header_plan(sheet[0], external) if sheet else None
                if plan is None:
                    rejected = {**known, "reason": reason or "no email column"}
                    yield pa.RecordBatch.from_pylist([rejected], schema=types)
                    continue
                for start in range(1, len(sheet), _BATCH_ROWS):
                    yield pa.RecordBatch.from_pylist([
                        {**known, "row_seq": start + i - 1, "cells": cells, "plan": plan}
                        for i, cells in enumerate(sheet[start:start + _BATCH_ROWS])
                    ], schema=types)

    return books.mapInArrow(read, schema).select(
        plain_file_name("file_path").alias("source_file"),
        F.timestamp_micros("modified").alias("file_modified"),
        "file_path",
        F.lit(0).cast("long").alias("block_start"),
        "row_seq", "cells", "plan", "reason",
    )


def read_workbooks(
    spark: SparkSession, path: str | list[str], external: object = None
) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, rejects) of all workbooks."""
    rows = workbook_rows(spark, path, external)
    rejects = append_files([
        rows.where(F.col("reason").isNotNull()).select("source_file", "file_path", "reason"),
        _refused(spark, path),
    ])
    return resolve_cells(rows.where(F.col("plan").isNotNull()), FILE_COLUMNS), rejects
