"""WARC archives: written from pages, read back as a table of payload chunks.

A record travels as rows of (record, chunk number, bytes), so neither writer nor reader ever holds a
payload whole; digests are carried from chunk to chunk.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import stored
from leadloom.llm.files import place, write_files
from leadloom.session import shared_folder

CHUNK_BYTES = 1 << 18
# Shorter payloads are always written in full.
REVISIT_FROM_BYTES = 1000
# A task starts a new file beyond this size.
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 16

CHUNK_SCHEMA = (
    "record_id string, page_id long, record_type string, refers_to long, target_uri string, "
    "chunk_no int, last boolean, body binary, payload_bytes long, payload_digest string"
)

# The line ends, version line and revisit profile of the format.
CRLF = b"\r\n"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of each page's payload, the chunks of a page next to each other.

    Of equal payloads of at least REVISIT_FROM_BYTES bytes, rows with the largest page_id are
    responses and the others name it in `refers_to`.  A null html is an empty payload, with one
    empty chunk.  A row without page_id revisits if another one has an id.  Pages of equal page_id
    are records of their own.  Groups of equal payloads are found on digests; the table of groups
    is stored, so Spark knows its size when it picks the join.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", body.alias("body")).select(
        "*", F.sha1("body").alias("digest"), F.length("body").cast("long").alias("n_bytes")
    )
    groups = (
        rows.where(F.col("n_bytes") >= REVISIT_FROM_BYTES)
        .groupBy("digest", "n_bytes")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    placed = rows.join(stored(groups, "warc-groups"), ["digest", "n_bytes"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    parts = F.greatest(F.ceil(F.col("n_bytes") / chunk_bytes), F.lit(1)).cast("int")
    number = F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))
    return (
        placed.withColumns({"refers_to": refers, "n_chunks": F.when(refers.isNull(), parts)
                            .otherwise(1)})
        .select("page_id", "url", "digest", "n_bytes", "refers_to", "body", "n_chunks",
                number.alias("chunk_no"))
        .withColumn(
            "body",
            F.when(F.col("refers_to").isNotNull(), F.lit(b""))
            .otherwise(F.substring("body", F.col("chunk_no") * chunk_bytes + 1, chunk_bytes)),
        )
    )


def record_id(page_id, digest: str) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{digest}>"


def page_of(record: str):
    page = record.split(":")[2]
    return None if page == "none" else int(page)


def record_head(row: dict) -> bytes:
    """Everything of a record before the payload."""
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        b"Content-Length: %d\r\n\r\n" % row["n_bytes"]
    )
    revisit = row["refers_to"] is not None
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(row["page_id"], row["digest"]),
        "WARC-Date": "1970-01-01T00:00:00Z",  # pages carry no time of capture
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{row['digest']}",
        "Content-Length": str(len(http) + (0 if revisit else row["n_bytes"])),
    }
    if row["url"]:
        # line ends and other controls may not stand in a header
        fields["WARC-Target-URI"] = quote(row["url"], safe="%/:?#[]@!$&'()*+,;=~-._")
    if revisit:
        fields["WARC-Refers-To"] = record_id(row["refers_to"], row["digest"])
        fields["WARC-Profile"] = PROFILE
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items())]
    return CRLF.join(lines) + CRLF + CRLF + http


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write gzip members, one per record, to files in `folder`; return the stored list of files."""
    names = ["page_id", "url", "digest", "n_bytes", "refers_to", "n_chunks", "chunk_no"]

    def write(batches: Iterator[pa.RecordBatch], create):
        uri = stream = member = None
        records = 0
        for batch in batches:
            heads = batch.select(names).to_pylist()
            bodies = batch.column(batch.schema.get_field_index("body"))
            for row, body in zip(heads, bodies, strict=True):
                if row["chunk_no"] == 0:
                    if stream is not None and stream.tell() >= FILE_BYTES:
                        yield uri, records, stream.tell()
                        stream.close()
                        stream = None
                    if stream is None:
                        (uri, stream), records = create(), 0
                    member = zlib.compressobj(3, wbits=31)
                    stream.write(member.compress(record_head(row)))
                stream.write(member.compress(body.as_buffer()))
                if row["chunk_no"] == row["n_chunks"] - 1:
                    stream.write(member.compress(CRLF + CRLF) + member.flush())
                    records += 1
        if stream is not None:
            size = stream.tell()
            stream.close()
            yield uri, records, size

    listing = "path string, records long, bytes long"
    return stored(write_files(chunks, folder, ".warc.gz", write, listing), "warc-files")


class Unzipped:
    """The text of a file of gzip members, by lines and by pieces of bounded size."""

    def __init__(self, stream):
        self.stream, self.member, self.rest = stream, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Get another piece; false at the end of the file."""
        while True:
            data = self.member.unconsumed_tail or self.member.unused_data
            if self.member.eof:
                self.member = zlib.decompressobj(31)
            data = data or self.stream.read(READ_BYTES)
            if not data:
                return False
            piece = self.member.decompress(data, READ_BYTES)
            if piece:
                self.rest += piece
                return True

    def line(self) -> bytes | None:
        while CRLF not in self.rest:
            if not self.more():
                return None
        line, _, self.rest = self.rest.partition(CRLF)
        return line

    def pieces(self, size: int, most: int) -> Iterator[bytes]:
        """The next `size` bytes in pieces of `most` bytes, the last one shorter."""
        while size:
            while len(self.rest) < min(size, most):
                if not self.more():
                    raise ValueError("the archive ends inside a record")
            piece, self.rest = self.rest[: min(size, most)], self.rest[min(size, most) :]
            size -= len(piece)
            yield piece

    def fields(self) -> dict[str, str]:
        found = {}
        while line := self.line():
            name, _, value = line.partition(b":")
            found[name.decode().lower()] = value.strip().decode()
        return found


def records(stream, with_body: bool = True) -> Iterator[tuple]:
    """Rows of CHUNK_SCHEMA of one archive: byte count and digest run on from chunk to chunk, those
    of the last chunk are the payload's."""
    text = Unzipped(stream)
    while (line := text.line()) is not None:
        if not line:  # between records
            continue
        if line != VERSION:
            raise ValueError(f"not a record: {line[:40]!r}")
        head = text.fields()
        left = int(head["content-length"])
        # the HTTP head counts as content
        http = [text.line()]
        while http[-1]:
            http.append(text.line())
        left -= sum(len(x) + len(CRLF) for x in http)
        claimed = head["warc-payload-digest"].removeprefix("sha1:")
        refers = head.get("warc-refers-to")
        record = head["warc-record-id"]
        shared = (
            record, page_of(record), head["warc-type"], page_of(refers) if refers else None,
            head.get("warc-target-uri"),
        )
        if head["warc-type"] == "revisit":
            size = next(int(x.partition(b":")[2]) for x in http if x.startswith(b"Content-Length"))
            yield *shared, 0, True, b"", size, claimed
            continue
        digest, size = hashlib.sha1(), 0
        number = 0
        for number, piece in enumerate(text.pieces(left, CHUNK_BYTES)):
            digest.update(piece)
            size += len(piece)
            if size < left:
                yield (*shared, number, False, piece if with_body else None, size,
                       digest.copy().hexdigest())
        if digest.hexdigest() != claimed:
            raise ValueError(f"{record} is damaged")
        last = (piece if size else b"") if with_body else None
        yield *shared, number, True, last, size, claimed


def read_archives(files: DataFrame, with_body: bool = True) -> DataFrame:
    """The chunk table of the listed archives; `with_body` false leaves the bytes out.  A digest that
    does not fit its payload raises."""
    names = [field.split()[0] for field in CHUNK_SCHEMA.split(",")]
    types = pa.schema([
        ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("target_uri", pa.string()), ("chunk_no", pa.int32()),
        ("last", pa.bool_()), ("body", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [dict(zip(names, row, strict=True)) for row in rows], types
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = place(uri)
                rows, held = [], 0
                with system.open_input_stream(path) as stream:
                    for row in records(stream, with_body):
                        rows.append(row)
                        held += len(row[7] or b"")
                        if len(rows) >= 4096 or held >= 4 * CHUNK_BYTES:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    paths = files.select("path")
    # files are few and large: one to a task
    spread = max(1, files.count())
    return paths.repartition(spread).mapInArrow(run, CHUNK_SCHEMA)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages as archives and read them back: the chunk table without bytes."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(payload_chunks(pages), folder), with_body=False)
