"""Header mapping, column resolution, file reading, dedup and bookkeeping."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from leadloom.operators.columns import (
    accept_external_mapping,
    header_key,
    header_question,
    map_headers,
    plan_mapping,
    resolve_columns,
    sample_rows,
)
from leadloom.operators.dedup import first_rows, mark_duplicates
from leadloom.operators.ingest import (
    clean_leads,
    history_rows,
    ingest_outcome,
    latest_uploads,
    new_leads,
    with_upload_id,
)
from leadloom.operators.joins import lookup_join
from leadloom.operators.upsert import upsert_by_key
from leadloom.sources.files import (
    ROW_ORDER,
    list_files,
    read_csv_files,
    read_workbooks,
    rejected_files,
    split_header,
    unique_headers,
)
from leadloom.sources.tables import read_bucketed, write_bucketed


def test_header_mapping():
    assert map_headers(["Full Name", "Email Address", "Mobile Number", "Company", "Row Id"]) == {
        "Full Name": "name", "Email Address": "email", "Mobile Number": "phone",
        "Company": "company_name",
    }
    assert map_headers(["E-Mail", "PIN Code", "country_code", "Web URL"]) == {
        "E-Mail": "email", "PIN Code": "pincode", "country_code": "country",
        "Web URL": "website_csv",
    }


def test_external_mapping():
    headers = ["mailto_field", "person_in_charge", "Name"]
    answer = {
        "mailto_field": "email", "person_in_charge": "name", "unknown": "city", "Name": "shoe",
        "x": 1,
    }
    assert accept_external_mapping(answer, headers) == {
        "mailto_field": "email", "person_in_charge": "name",
    }
    assert accept_external_mapping("nonsense", headers) == {}
    assert plan_mapping(headers, answer) == {
        "Name": "name", "mailto_field": "email", "person_in_charge": "name",
    }
    assert plan_mapping(["Email", "Company"], {"Company": "city"})["Company"] == "company_name"
    assert plan_mapping(["Name", "Company"], {"Company": "email"})["Company"] == "email"
    with pytest.raises(ValueError, match="email column"):
        plan_mapping(["Name", "Phone"])


def test_header_question_holds_headers_and_samples():
    text = header_question(["MAÍL"], [{"MAÍL": "a@b.c"}])
    assert '["MAÍL"]' in text and '"MAÍL": "a@b.c"' in text and "website_csv, notes, fax" in text


def test_resolution_last_filled_wins(spark):
    rows = spark.createDataFrame(
        [
            ("a@x.com", " ", "F", "L", "n.1", "k"),
            ("a@x.com", "b@x.com", "F", "", " ", ""),
            ("", "", None, "L", None, None),
        ],
        ["Email", "Work Email", "First Name", "last_name", "First-Name", "Code.1"],
    )
    found = resolve_columns(rows, map_headers(rows.columns)).select(
        "email", "name", "raw_data"
    ).collect()
    assert [tuple(r) for r in found] == [
        ("a@x.com", "n.1", {"Code.1": "k"}), ("b@x.com", "F", {}), (None, "L", {}),
    ]


def test_sample_rows(spark):
    rows = spark.createDataFrame(
        [(0, " ", "", None), (1, "x", " ", "y" * 300), (2, "", "", ""), (3, "z", None, "")],
        "i int, a string, b string, c string",
    )
    found = sample_rows(rows, ["a", "b", "c"], ["i"]).collect()
    assert [r.cells for r in found] == [{"a": "x", "c": "y" * 200}, {"a": "z"}]
    many = spark.range(40).select(F.col("id").alias("i"), F.lit("v").alias("a"))
    assert [r.i for r in sample_rows(many, ["a"], ["i"]).collect()] == [0, 1, 2]


@pytest.fixture
def upload(tmp_path):
    folder = tmp_path / "uploads"
    folder.mkdir()
    (folder / "a.csv").write_text(
        'Name,Email,Phone,Company,Code\n"Raj ""R"" Patel",raj@example.in,9876543210,"ABC, Ltd",7\n'
        "Short,short@x.com\nLong,long@x.com,1,2,3,4\n\nNo Mail,,1,,\n",
        encoding="utf-8",
    )
    (folder / "b b.csv").write_bytes(
        "﻿Email,Name,Email\nDUP@X.COM,Dürer,z@x.com\ndup@x.com,Two,\nraj@example.in,R,\n"
        .encode("utf-8")
    )
    (folder / "c.CSV").write_bytes("EmailID,City\nc@x.com,Orléans “€”\n".encode("cp1252"))
    (folder / "d.csv").write_bytes(b"mail,town\nd@x.com,\xe9\x81\n")
    (folder / "e.csv").write_text("Name,Phone\nx,1\n")
    (folder / "notes.txt").write_text("no")
    (folder / "old.xls").write_text("no")
    return str(folder)


def test_csv_files(spark, upload):
    rows, rejects = read_csv_files(spark, upload)
    assert sorted((r.source_file, r.reason) for r in rejects.collect()) == [
        ("a.csv", "too many cells"), ("e.csv", "no email column"), ("notes.txt", "extension"),
        ("old.xls", "unsupported"),
    ]
    cleaned = clean_leads(rows).cache()
    assert cleaned.count() == 8
    found = {r.email: r for r in new_leads(cleaned, ROW_ORDER).collect()}
    assert sorted(found) == [
        "c@x.com", "d@x.com", "dup@x.com", "raj@example.in", "short@x.com",
    ]
    assert found["raj@example.in"].name == 'Raj "R" Patel'
    assert found["raj@example.in"].company_name == "ABC, Ltd"
    assert found["raj@example.in"].phone == "+919876543210"
    assert found["raj@example.in"].raw_data == {"Code": "7"}
    assert found["raj@example.in"].data_quality_score == 0.75
    assert found["dup@x.com"].name == "Dürer"
    assert found["dup@x.com"].raw_data == {"Email.1": "z@x.com"}
    assert found["c@x.com"].city == "Orléans “€”"
    assert found["d@x.com"].city == "é\x81"
    outcome = {r.filename: tuple(r)[1:] for r in ingest_outcome(cleaned, ROW_ORDER).collect()}
    # total, new, duplicate, skipped
    assert outcome == {
        "a.csv": (3, 2, 0, 1), "b b.csv": (3, 1, 2, 0), "c.CSV": (1, 1, 0, 0),
        "d.csv": (1, 1, 0, 0),
    }
    again = ingest_outcome(cleaned, ROW_ORDER, new_leads(cleaned, ROW_ORDER))
    assert again.agg(F.sum("new_records")).first()[0] == 0


def test_folders_without_usable_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("no")
    with pytest.raises(FileNotFoundError):
        read_csv_files(spark, str(tmp_path))
    (tmp_path / "x.csv").write_text("Name,Phone\nx,1\n")
    with pytest.raises(ValueError, match="email column"):
        read_csv_files(spark, str(tmp_path))
    rows, _ = read_csv_files(spark, str(tmp_path), external={"Phone": "email"})
    assert rows.first().email == "1"


def test_history_rows(spark):
    outcome = spark.sql("select 'a' filename, 3L total_records")
    row = history_rows(outcome, F.expr("timestamp '2024-02-01 00:00:00'"), "me").first()
    assert (row.uploaded_by, row.uploaded_at.year) == ("me", 2024)


def test_upload_guard(spark, upload):
    verdicts = {r.filename: r.verdict for r in list_files(spark, upload).collect()}
    assert verdicts == {
        "a.csv": "accepted", "b b.csv": "accepted", "c.CSV": "accepted", "d.csv": "accepted",
        "e.csv": "accepted", "notes.txt": "extension", "old.xls": "unsupported",
    }
    assert rejected_files(spark, upload).count() == 2


def test_header_lines():
    assert split_header('a,"b, ""c""",,d') == ["a", 'b, "c"', "", "d"]
    assert unique_headers(["E", "E", "", "E"]) == ["E", "E.1", "Unnamed: 2", "E.2"]
    assert unique_headers(["E", "E", "E.1", "E"]) == ["E", "E.2", "E.1", "E.3"]


def test_any_header_can_be_read(spark, tmp_path):
    """Headers equal but for case, names the reader uses itself, repeated names, dots, backticks."""
    (tmp_path / "a.csv").write_text("Email,email,Name,source_file\na@x.com,,A,s\n,b@x.com,B,\n")
    (tmp_path / "b.csv").write_text("Email,Email,Email.1,row_seq,_overflow\nc@x.com,2,1,7,o\n")
    (tmp_path / "c.csv").write_text('file_path,"E-Mail","x.`y"\np,d@x.com,"q, r"\n')
    (tmp_path / "d.csv").write_text("Name,EMAIL\nD,e@x.com\n")
    rows, rejects = read_csv_files(spark, str(tmp_path))
    assert rejects.count() == 0
    found = {r.email: (r.name, r.raw_data) for r in rows.collect()}
    assert found == {
        "a@x.com": ("A", {"source_file": "s"}), "b@x.com": ("B", {}),
        "c@x.com": (None, {"Email.2": "2", "Email.1": "1", "row_seq": "7", "_overflow": "o"}),
        "d@x.com": (None, {"file_path": "p", "x.`y": "q, r"}), "e@x.com": ("D", {}),
    }


def test_external_mapping_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Kontakt,Wert\nA,a@x.com\n")
    (tmp_path / "b.csv").write_text("Kontakt,Wert\nb@x.com,B\n")
    mappings = spark.createDataFrame(
        [("a.csv", {"Wert": "email", "Kontakt": "name"}), ("b.csv", {"Kontakt": "email"})],
        "source_file string, mapping map<string,string>",
    )
    rows, _ = read_csv_files(spark, str(tmp_path), external=mappings)
    assert sorted((r.email, r.name, str(r.raw_data)) for r in rows.collect()) == [
        ("a@x.com", "A", "{}"), ("b@x.com", None, "{'Wert': 'B'}"),
    ]


def test_large_file_is_read_in_splits(spark, tmp_path):
    """A file beyond any upload limit of the past is kept, next to a one-row file."""
    line = "x" * 200
    with open(tmp_path / "big.csv", "w") as out:
        out.write("Email,Notes\n")
        out.writelines(f"u{i}@x.com,{line}\n" for i in range(260_000))
    (tmp_path / "small.csv").write_text("Email\nlast@x.com\n")
    rows, rejects = read_csv_files(spark, str(tmp_path))
    assert (rows.count(), rejects.count()) == (260_001, 0)
    assert rows.select("email").distinct().count() == 260_001


def _workbook(path, rows):
    shared = sorted({c for r in rows for c in r if isinstance(c, str)})
    cells = []
    for i, row in enumerate(rows, 1):
        parts = []
        for j, cell in enumerate(row):
            place = f"{chr(65 + j)}{i}"
            if isinstance(cell, str):
                parts.append(f'<c r="{place}" t="s"><v>{shared.index(cell)}</v></c>')
            elif cell is not None:
                parts.append(f'<c r="{place}"><v>{cell}</v></c>')
        cells.append(f'<row r="{i}">{"".join(parts)}</row>')
    name = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr(
            "xl/sharedStrings.xml",
            f'<sst xmlns="{name}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>",
        )
        book.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet xmlns="{name}"><sheetData>{"".join(cells)}</sheetData></worksheet>',
        )


def test_workbooks(spark, tmp_path):
    _workbook(tmp_path / "one.xlsx", [
        ["First Name", "Last Name", "Work Email", "Pincode"],
        ["Neha", "Shah", "Neha@X.com", 411001],
        [None, "Rao", "rao@x.com", None],
    ])
    _workbook(tmp_path / "two.xlsx", [["EmailID", "Code"], ["neha@x.com", 7.0]])
    _workbook(tmp_path / "empty.xlsx", [["Email"]])
    (tmp_path / "broken.xlsx").write_text("no")
    _workbook(tmp_path / "phones.xlsx", [["Phone"], ["1"]])
    rows, rejects = read_workbooks(spark, str(tmp_path))
    assert sorted((r.source_file, r.reason) for r in rejects.collect()) == [
        ("broken.xlsx", "unreadable"), ("phones.xlsx", "no email column"),
    ]
    rows = clean_leads(rows)
    found = {r.email: r for r in new_leads(rows, ROW_ORDER).collect()}
    assert sorted(found) == ["neha@x.com", "rao@x.com"]
    assert (found["neha@x.com"].name, found["neha@x.com"].pincode) == ("Neha Shah", "411001")
    assert found["neha@x.com"].source_file == "one.xlsx"
    assert found["rao@x.com"].name == "Rao"
    assert {r.filename: r.total_records for r in ingest_outcome(rows, ROW_ORDER).collect()} == {
        "one.xlsx": 2, "two.xlsx": 1,
    }


def _hot_rows(spark, n=6000):
    """A third of the rows carry one address, a tenth none."""
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        F.concat(F.lit("f"), F.col("id") % 5).alias("source_file"),
        F.when(F.col("id") % 3 == 0, "hot@x.com")
        .when(F.col("id") % 10 != 1, F.concat(F.col("id") % 700, F.lit("@x.com")))
        .alias("email"),
    )


@pytest.mark.parametrize("salts", [1, 1024])
def test_marks_do_not_depend_on_splits(spark, salts):
    rows = _hot_rows(spark).repartition(7)
    marked = mark_duplicates(rows, ["source_file", "row_id"], salts=salts)
    assert marked.count() == 6000
    new = {(r.row_id, r.email) for r in marked.where("outcome = 'new'").collect()}
    firsts = {}
    for r in sorted(rows.collect(), key=lambda r: (r.source_file, r.row_id)):
        if r.email:
            firsts.setdefault(r.email, r.row_id)
    assert new == {(i, e) for e, i in firsts.items()}
    assert marked.where("email is null and outcome <> 'skipped'").count() == 0
    winners = first_rows(rows, order=["source_file", "row_id"]).select("row_id", "email").collect()
    assert {tuple(r) for r in winners} == new


def test_hot_address_stays_small_before_the_shuffle(spark):
    """The plan limits a key to one row per task before rows are exchanged."""
    plan = first_rows(_hot_rows(spark), order=["row_id"])._jdf.queryExecution().toString()
    partial = plan.rindex("WindowGroupLimit")
    assert plan[partial:].split("\n")[0].endswith("Partial")
    assert plan.rindex("Exchange hashpartitioning") < partial


def test_marks_against_stored(spark):
    rows = _hot_rows(spark)
    stored = spark.sql("select 'hot@x.com' email")
    marked = mark_duplicates(rows, ["row_id"], stored=stored, salts=8)
    assert marked.where("email = 'hot@x.com' and outcome <> 'duplicate'").count() == 0


def test_lookup_join_keeps_all_rows(spark):
    left = _hot_rows(spark)
    right = left.where("email is not null").select("email").distinct().withColumn("v", F.lit(1))
    counts = left.groupBy("email").agg(F.count("*").alias("n"))
    plain = lookup_join(left, right, "email", ["row_id"])
    split = lookup_join(left, right, "email", ["row_id"], counts=counts, rows_per_task=10)
    assert plain.count() == split.count() == 6000
    assert split.exceptAll(plain.select(split.columns)).count() == 0


def test_upload_ids(spark):
    history = spark.sql(
        "select * from values (1L, 'a'), (2L, 'b'), (3L, 'a') as t(id, filename)"
    )
    results = spark.sql("select * from values ('a'), ('c') as t(filename)")
    found = {r.filename: r.upload_id for r in with_upload_id(results, history).collect()}
    assert found == {"a": 3, "c": 0}
    assert [r.id for r in latest_uploads(history, 2).collect()] == [3, 2]


def test_header_key_column(values):
    assert values(header_key, ["E-Mail ID", "PIN_Code", "Ünï"]) == ["emailid", "pincode", "n"]


def test_joins_leave_bucketed_rows_where_they_are(spark, tmp_path):
    """The stored side is scanned and joined without an exchange; only the changes move."""
    rows = spark.range(500).select(
        F.concat("id", F.lit("@x.in")).alias("email"), F.col("id").alias("n"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )
    path = f"{tmp_path}/leads"
    write_bucketed(rows, path, "email", 16)
    changes = rows.where("n % 7 = 0").select("email", (F.col("n") + 1000).alias("n"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = read_bucketed(spark, path, "email", 16, {"late": "string"})
        updated = upsert_by_key(stored, changes, F.expr("timestamp '2024-02-01 00:00:00'"))
        fresh = new_leads(changes, ["n"], stored)
        for frame, exchanges in ((updated, 1), (fresh, 2)):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") <= exchanges, plan
            branch = next(
                line for line in plan.splitlines() if "FileScan" in line and "Bucketed: true" in line
            )
            assert branch
        found = {r.email: r.n for r in updated.collect()}
        assert found == {f"{i}@x.in": i + 1000 * (i % 7 == 0) for i in range(500)}
        assert fresh.count() == 0 and "late" in updated.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
