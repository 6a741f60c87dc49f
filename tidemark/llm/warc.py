"""WARC archives: writing, reading, and revisit records for equal payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import small_batches
from tidemark.session import shared_folder, stage

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
HEADERS = pa.schema([
    ("file", pa.string()), ("position", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("record_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()),
])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    """The same record gets the same id whenever its task runs again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{digest}')}>"


def record(kind: str, fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", level, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, date: str, refers: tuple | None = None) -> bytes:
    """A response with its payload, or a revisit without one. refers: (page_id, url, record id) of the response."""
    kind = "revisit" if refers else "response"
    fields = [("WARC-Record-ID", record_id(page_id, digest, kind)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]|")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if refers:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", refers[2])]
        if refers[1] is not None:
            fields.append(("WARC-Refers-To-Target-URI", quote(refers[1], safe="%/:=&?~#+!$,;'@()*[]|")))
        fields.append(("X-Refers-To-Page", str(refers[0])))
    else:
        fields.append(("Content-Type", "text/html; charset=utf-8"))
    fields += [("X-Page", str(page_id)), ("X-Payload-Length", str(len(payload)))]
    return record(kind, fields, b"" if refers else payload)


class ArchiveWriter:
    """Rolls archives in a shared folder. A file gets its final name when whole, and a name no other attempt has;
    only names that a finished task returns count, so lost or repeated tasks leave no record in the result."""

    def __init__(self, folder: str, date: str, most_records: int = 2000, most_bytes: int = 64 << 20):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.date, self.most_records, self.most_bytes = date, most_records, most_bytes
        self.out, self.name, self.done = None, "", []
        self.records = self.size = 0

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            self.out = self.files.open_output_stream(self.name + ".part", compression=None)
            head = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date),
                                       ("Content-Type", "application/warc-fields")], b"software: tidemark\r\nformat: WARC File Format 1.1\r\n")
            self.out.write(head)
            self.records, self.size = 0, len(head)
        self.out.write(data)
        self.records += 1
        self.size += len(data)
        if self.records >= self.most_records or self.size >= self.most_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.move(self.name + ".part", self.name)
            self.done.append((self.name, self.records, self.size))
            self.out = None

    def finished(self) -> list[tuple]:
        rows, self.done = self.done, []
        return rows


def read_records(folder: str, file: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position in the file, fields, block) of each record; one record is in memory at a time."""
    files, _ = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(file, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(_Raw(raw), 1 << 20)) as data:
        position = 0
        while True:
            line = data.readline()
            if not line:
                return
            if not line.strip():
                continue
            fields = {}
            while (line := data.readline()) not in (b"\r\n", b""):
                key, _, value = line.decode().rstrip("\r\n").partition(": ")
                fields[key] = value
            yield position, fields, data.read(int(fields["Content-Length"]))
            position += 1


class _Raw(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.stream.read(len(into))
        into[: len(data)] = data
        return len(data)


def new_folder(spark, label: str) -> str:
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return folder


def _number(text: str | None) -> int | None:
    return None if text in (None, "None") else int(text)


def write_archives(pages: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """One response record per page; returns the written files (file, records, bytes). No shuffle.

    pages: page_id, url, html; other columns are not read. A null html is an empty payload, a null url leaves the
    target out, a null page_id is kept as null; repeated rows are records of their own.
    """
    small_batches(pages.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, date)
        for batch in batches:
            for page_id, url, text in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                payload = (text or "").encode()
                writer.add(page_record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), date))
            yield _rows(FILES, writer.finished())
        writer.close()
        yield _rows(FILES, writer.finished())

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    return stage(source.mapInArrow(run, _ddl(FILES)), "files")


def read_headers(files: DataFrame, folder: str) -> DataFrame:
    """A row per page record of the archives, without payloads; the digest of a response is taken from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                out = []
                for position, fields, block in read_records(folder, file):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest = (hashlib.sha1(block).hexdigest() if kind == "response"
                              else base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex())
                    size = len(block) if kind == "response" else int(fields["X-Payload-Length"])
                    out.append((file, position, kind, _number(fields.get("X-Page")), fields.get("WARC-Target-URI"),
                                fields["WARC-Record-ID"], digest, size, _number(fields.get("X-Refers-To-Page"))))
                yield _rows(HEADERS, out)

    return _spread(files).mapInArrow(run, _ddl(HEADERS))


def _spread(files: DataFrame) -> DataFrame:
    """Files over the tasks: their list is small, their reading is not."""
    return files.select("file").repartition(_tasks(files), "file")


def _tasks(frame: DataFrame) -> int:
    """A fixed number, since Spark would merge partitions of so few bytes into one task."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def resolve_revisits(headers: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Headers with record_type and refers_to decided anew.

    Of records with one digest and at least ``least_bytes``, that with the largest page_id (ties by file and position;
    null ids last) stays a response, the others revisit it. Only headers are shuffled, by digest; the response of a digest
    is a maximum, combined before the shuffle, so a digest of very many records is no single task's work.
    """
    long = headers.filter(F.col("payload_bytes") >= least_bytes)
    first = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("order"), "file", "position", "page_id", "url", "record_id")
    originals = (
        long.groupBy("payload_digest").agg(F.max(first).alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    is_copy = F.col("original").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~(
        (F.col("original.file") == F.col("file")) & (F.col("original.position") == F.col("position")))
    return headers.join(originals, "payload_digest", "left").select(
        "file", "position", "page_id", "url", "payload_digest", "payload_bytes", is_copy.alias("copy"),
        *[F.when(is_copy, F.col(f"original.{c}")).alias(f"to_{c}") for c in ("page_id", "url", "record_id")])


def write_deduplicated(headers: DataFrame, source: str, folder: str, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Archives in which copies are revisit records; returns the written files.

    The decisions on one archive, as many as its records, go to the task that reads it and writes it anew with fresh
    headers. Payloads are not shuffled.
    """
    columns = ["position", "copy", "to_page_id", "to_url", "to_record_id"]

    def run(decisions: pa.Table) -> pa.Table:
        file = decisions.column("file")[0].as_py()
        copies = {p: (a, b, c) for p, copy, a, b, c in zip(*(decisions.column(x).to_pylist() for x in columns)) if copy}
        writer = ArchiveWriter(folder, date)
        for position, fields, block in read_records(source, file):
            if fields["WARC-Type"] == "response":
                digest = hashlib.sha1(block).hexdigest()
                writer.add(page_record(_number(fields["X-Page"]), fields.get("WARC-Target-URI"), block, digest, date, copies.get(position)))
        writer.close()
        return pa.Table.from_batches([_rows(FILES, writer.finished())])

    spread = headers.select("file", *columns).repartition(_tasks(headers), "file")
    return stage(spread.groupBy("file").applyInArrow(run, _ddl(FILES)), "files")


def deduplicate(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Pages to archives, copies to revisit records, and the headers of the archives read back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url, file. An empty table gives no rows.
    """
    spark = pages.sparkSession
    raw = new_folder(spark, "warc")
    headers = stage(read_headers(write_archives(pages, raw), raw), "headers")
    out = new_folder(spark, "warc")
    files = write_deduplicated(resolve_revisits(headers, least_bytes), raw, out)
    return read_headers(files, out).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file")
