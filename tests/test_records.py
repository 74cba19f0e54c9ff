"""Rows with quoted line breaks, read from files cut into many blocks."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators.ingest import clean_leads
from leadloom.sources.files import csv_blocks, read_csv_files
from leadloom.sources.records import (
    block_maps,
    block_states,
    csv_lines,
    open_after,
    records,
)


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of some dozens of bytes."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(n) for n in names]

    def cut(size: int) -> None:
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield cut
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def python_rows(text: str) -> list[str]:
    """The rows of a file as the standard reader cuts them, by the lines that it takes."""
    lines = text.split("\n")
    taken = []
    reader = csv.reader(iter([line + "\n" for line in lines]))
    start = 0
    for _ in reader:
        row = "\n".join(lines[start:reader.line_num])
        if row.strip():
            taken.append(row)
        start = reader.line_num
    return taken


def test_open_quotes():
    cases = {
        ("", False): False, ("", True): True, ('a,"b', False): True, ('a,"b"', False): False,
        ('5" pipe,x', False): False, ('"a""', False): True, ('"a"""', False): False,
        ('x"', True): False, ('""', True): True, ('x","y', True): True, ('x",y"z', True): False,
        ('"a"b"c,d', False): False, ('a, "b', False): False,
    }
    assert {c: open_after(c[0].encode(), c[1]) for c in cases} == cases


@pytest.mark.parametrize("size", [9, 50, 1 << 20])
def test_rows_across_blocks(spark, tmp_path, small_blocks, size):
    """Random texts of quotes, commas and line breaks against the standard library's reader."""
    small_blocks(size)
    draw = random.Random(size)
    texts = {}
    while len(texts) < 25:
        cells = ['"', '""', ",", "\n", "a", "b c", 'q"', ',"', '",', "\n\n", "é"]
        text = "h\n" + "".join(draw.choices(cells, k=draw.randint(1, 120)))
        if len(texts) >= 5:  # the others as they come, whether or not their quotes close
            name = f"{len(texts)}.csv"
        else:
            text = 'h\n"' + "line\n" * 30 + '",x\n' + text
            name = f"long{len(texts)}.csv"
        texts[name] = text
        (tmp_path / name).write_bytes(text.encode())
    lines = csv_lines(spark, str(tmp_path))
    blocks = csv_blocks(lines)
    states = block_states(blocks, block_maps(lines)).cache()
    n_blocks = states.count()
    assert size > 1000 or n_blocks > 60
    closed = {
        r.file_path.rsplit("/", 1)[1]: not r.unclosed
        for r in states.groupBy("file_path")
        .agg(F.max_by("ends_inside", "block_start").alias("unclosed")).collect()
    }
    headers, rows = records(lines, states, n_blocks)
    found: dict[str, list] = {}
    for r in headers.unionByName(rows).orderBy("file_path", "block_start", "row_seq").collect():
        found.setdefault(r.file_path.rsplit("/", 1)[1], []).append(r.record.decode())
    for name, text in texts.items():
        reader = csv.reader(io.StringIO(text), strict=False)
        list(reader)
        if closed[name]:
            assert found[name] == python_rows(text), name
    assert sum(closed.values()) > 5 and not all(closed.values())


def test_files_with_quoted_line_breaks(spark, tmp_path, small_blocks):
    small_blocks(64)
    note = "first line\nsecond, with a comma\n\n\"\"quoted\"\" end"
    (tmp_path / "multi.csv").write_text(
        "﻿Name,Email,\"Street\nand No\",Memo\n"
        + "".join(f'N{i},n{i}@x.com,S{i},"{note} {i}"\n' for i in range(40))
        + "Long,long@x.com,1,2,3\nShort,short@x.com\n",
        encoding="utf-8",
    )
    (tmp_path / "cp.csv").write_bytes(
        "Email,City\r\na@x.com,\"Orl\xe9ans\r\n\x80\"\r\n\r\nb@x.com,5\" pipe\r\n".encode("latin-1")
    )
    (tmp_path / "plain.csv").write_text('Email,City\nc@x.com,5" pipe\nd@x.com,6" pipe\n')
    (tmp_path / "open.csv").write_text('Email,City\ne@x.com,"never closed\nf@x.com,x\n')
    rows, rejects = read_csv_files(spark, str(tmp_path))
    found = {r.email: r for r in clean_leads(rows).collect()}
    assert set(found) == {f"n{i}@x.com" for i in range(40)} | {
        "a@x.com", "b@x.com", "c@x.com", "d@x.com", "short@x.com",
    }
    assert found["n7@x.com"].raw_data == {
        "Street\nand No": "S7", "Memo": 'first line\nsecond, with a comma\n\n"quoted" end 7',
    }
    assert found["a@x.com"].city == "Orléans\n€" and found["b@x.com"].city == '5" pipe'
    assert found["d@x.com"].city == '6" pipe'
    assert sorted((r.source_file, r.reason) for r in rejects.collect()) == [
        ("multi.csv", "too many cells"), ("open.csv", "unclosed quote"),
    ]
