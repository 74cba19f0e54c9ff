"""Streams give the batch results, file by file and when a batch is repeated."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadloom.operators.throttle import admit_hits
from leadloom.streaming.ingest import (
    ProgressRows,
    first_arrivals,
    first_arrivals_within,
    run_to_end,
    stream_leads,
    upload_stream,
)
from leadloom.streaming.throttle import admit_stream, use_rocksdb

def _run(spark, folder, on_batch=None, files_per_batch=1):
    run_to_end(stream_leads(
        upload_stream(spark, f"{folder}/in", files_per_batch), f"{folder}/leads",
        f"{folder}/uploads", f"{folder}/rows", f"{folder}/rejects", f"{folder}/checkpoint",
        on_batch=on_batch,
    ))
    leads = spark.read.parquet(f"{folder}/leads")
    uploads = spark.read.parquet(f"{folder}/uploads")
    return (
        {r.email: r.name for r in leads.collect()},
        {r.filename: (r.total_records, r.new_records, r.duplicate_records, r.skipped_records)
         for r in uploads.collect()},
    )


def test_files_over_time(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("Email,Name\na@x.com,A\nA@X.com,A2\nbad,B\n")
    listener = ProgressRows()
    spark.streams.addListener(listener)
    try:
        leads, uploads = _run(spark, tmp_path)
        assert leads == {"a@x.com": "A"}
        assert uploads == {"a.csv": (3, 1, 1, 1)}
        (folder / "b.csv").write_text("Email,Name\na@x.com,A3\nb@x.com,B\n")
        seen = {}
        leads, uploads = _run(spark, tmp_path, seen.__setitem__)
        assert leads == {"a@x.com": "A", "b@x.com": "B"}
        assert seen == {1: {"new_records": 1, "data_quality_score": 0.45}}
        assert uploads["b.csv"] == (2, 1, 1, 0)
        assert _run(spark, tmp_path) == (leads, uploads)
    finally:
        spark.streams.removeListener(listener)


def test_dialects_of_one_batch(spark, tmp_path):
    """Columns in another order, other headers, another encoding, quoted line breaks, names with
    blanks, escapes and pattern letters, files to refuse; then a batch of nothing usable."""
    folder = tmp_path / "in"
    (folder / "more").mkdir(parents=True)
    (folder / "a b%20+[1].csv").write_text("Name,Email\nA,a@x.com\n")
    (folder / "more" / "{b}*.csv").write_bytes("E-Mail,City,Full Name\nb@x.com,x,Zo\xeb\n".encode("latin-1"))
    (folder / "c.csv").write_text('fullname,mail\n"C\n""two""",c@x.com\nD,a@x.com\n')
    (folder / "bad.csv").write_text("Name,Phone\nx,1\n")
    (folder / "notes.txt").write_text("no")
    leads, uploads = _run(spark, tmp_path, files_per_batch=10)
    assert leads == {"a@x.com": "A", "b@x.com": "Zoë", "c@x.com": 'C\n"two"'}
    assert uploads == {"a b%20+[1].csv": (1, 1, 0, 0), "{b}*.csv": (1, 1, 0, 0),
                       "c.csv": (2, 1, 1, 0)}

    def rejects():
        found = spark.read.parquet(f"{tmp_path}/rejects").collect()
        return sorted((r.source_file, r.reason) for r in found)

    assert rejects() == [("bad.csv", "no email column"), ("notes.txt", "extension")]
    (folder / "late.txt").write_text("no")
    again, _ = _run(spark, tmp_path, files_per_batch=10)
    assert again == leads and ("late.txt", "extension") in rejects()


@pytest.mark.parametrize("bounded", [False, True])
def test_first_arrivals(spark, tmp_path, bounded):
    rows = spark.sql(
        "select * from values ('a', timestamp '2024-01-01 00:00:00'), "
        "('a', timestamp '2024-01-01 00:01:00'), ('b', timestamp '2024-01-01 00:02:00'), "
        "(null, timestamp '2024-01-01 00:02:00') as t(email, ts)"
    )
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    firsts = first_arrivals_within(stream, "ts", "1 hour") if bounded else first_arrivals(stream)
    query = (
        firsts.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c")
        .trigger(availableNow=True).start(f"{tmp_path}/out")
    )
    run_to_end(query)
    assert sorted(r.email for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_stream_admission_equals_batch(spark, tmp_path):
    rows = spark.range(600).select(
        F.col("id"), F.concat(F.lit("k"), F.col("id") % 4).alias("key"),
        F.timestamp_seconds(F.col("id") * 7).alias("ts"),
    )
    for start in range(0, 600, 200):
        part = rows.where(F.col("id").between(start, start + 199)).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/in")
    use_rocksdb(spark)
    stream = (
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
        .parquet(f"{tmp_path}/in")
    )
    query = (
        admit_stream(stream, "key", "ts", "id", 3, 100)
        .writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c")
        .trigger(availableNow=True).start(f"{tmp_path}/out")
    )
    run_to_end(query)
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    batch = admit_hits(rows, "key", "ts", "id", 3, 100).collect()
    assert not any(r.late for r in found)
    assert {r.id: r.admitted for r in found} == {r.id: r.admitted for r in batch}
