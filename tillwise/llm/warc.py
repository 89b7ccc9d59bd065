"""Deterministic sharded WARC files, and reading them back.

Pages are dealt out by ranges of page_id. Payloads of FIRST_LENGTH bytes or more that occur again
become revisits of the record with the smallest page_id; what repeats is found on ids and digests
alone, and reaches the writer as marker rows that sort just before the pages they are about.
Headers and digests are made anew from the page. Each record is a gzip member of its own; a file
is closed once its compressed size reaches ``file_bytes``.

Tasks write under temporary names. The manifest of what the successful tasks wrote is stored
first, then files are moved to their final names, which depend on the input alone, then the
manifest is put beside them: a folder without one is not complete, and files that a manifest does
not name do not count.

Defined results: a null html is an empty payload, a null url leaves out the target; a null
page_id sorts first and is the smallest of a group only if all are null; of repeated rows the
first is the response, the others revisit it; an empty table writes no file.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm.frames import file_system
from tillwise.staging import Stage, checkpoint_root

FILE_BYTES = 512 << 20
#: Payloads shorter than this are always written whole.
FIRST_LENGTH = 100
#: Written as the date of every record, so that equal input makes equal files.
DATE = "1970-01-01T00:00:00Z"
#: Fixed value: the profile of a revisit with the same payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page-records")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

MANIFEST = T.StructType(
    [
        T.StructField("draft", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
    ]
)
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id} {digest} {copy}')}>"


def _header(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None, copy: int) -> bytes:
    """A response, or a revisit if ``refers_to`` holds the (page_id,) of the response."""
    digest = hashlib.sha256(payload).hexdigest()
    head = _HTTP % len(payload)
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, copy)),
        ("WARC-Target-URI", target),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-ID", page_id),
        ("X-Payload-Length", len(payload)),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to[0], digest)),
            ("X-Refers-To-Page-ID", refers_to[0]),
        ]
    return _header(fields, head + payload if refers_to is None else head)


class ArchiveWriter:
    """Writes one task's records to files that roll by compressed size."""

    def __init__(self, folder: str, shard: int, limit: int) -> None:
        self.fs, self.folder = file_system(folder)
        self.shard, self.limit, self.part, self.out = shard, limit, 0, None

    def add(self, record: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.file = f"pages-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.draft = f"{self.file}.{uuid.uuid4().hex}.tmp"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.draft}", compression=None)
            self.records, self.size, self.digest = 0, 0, hashlib.sha256()
            about = f"software: page archive\r\nformat: WARC File Format 1.1\r\nfile: {self.file}\r\n".encode()
            fields = [
                ("WARC-Type", "warcinfo"),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, self.file)}>"),
                ("WARC-Date", DATE),
                ("WARC-Filename", self.file),
                ("Content-Type", "application/warc-fields"),
            ]
            self.put(_header(fields, about))
        self.put(record)
        self.records += 1
        if self.size >= self.limit:
            yield from self.close()

    def put(self, record: bytes) -> None:
        data = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = data.compress(record) + data.flush()
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            yield self.draft, self.file, self.records, self.size, self.digest.hexdigest()
            self.out, self.part = None, self.part + 1


def _with_markers(pages: DataFrame) -> DataFrame:
    """The pages, and for each that shares its payload a marker with the first page's id."""
    payload = F.coalesce("html", F.lit(""))
    whole = pages.select(
        "page_id",
        F.sha2(payload, 256).alias("digest"),
        F.lit(True).alias("whole"),
        "url",
        payload.alias("html"),
        F.lit(None).cast("long").alias("first"),
    )
    narrow = whole.where(F.octet_length("html") >= FIRST_LENGTH).select("page_id", "digest")
    shared = (
        narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    )
    markers = narrow.distinct().join(shared, "digest").select(
        "page_id", "digest", F.lit(False).alias("whole"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("html"), "first",
    )
    return whole.unionByName(markers)


def write_archives(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> str:
    """Write the pages; returns the folder, which must be on storage that all executors share."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    fs, local = file_system(folder)
    fs.create_dir(local, recursive=True)
    dealt = (
        _with_markers(pages)
        .repartitionByRange("page_id", "digest")
        .sortWithinPartitions("page_id", "digest", "whole", "url")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, TaskContext.get().partitionId(), file_bytes)
        done: list[tuple] = []
        marker, key, copy = None, None, 0
        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "digest", "whole", "url", "html", "first"))
            for row in zip(*columns, strict=True):
                page_id, digest, whole, url, html, first = (x.as_py() for x in row)
                if not whole:
                    marker = page_id, digest, first
                    continue
                copy = copy + 1 if (page_id, digest) == key else 0
                key = page_id, digest
                revisit = marker is not None and marker[:2] == key and (page_id != marker[2] or copy > 0)
                refers_to = (marker[2],) if revisit else None
                done.extend(writer.add(page_record(page_id, url, html.encode(), refers_to, copy)))
        done.extend(writer.close())
        yield pa.RecordBatch.from_pylist(
            [dict(zip(MANIFEST.names, x, strict=True)) for x in done], _MANIFEST_ARROW
        )

    written = Stage(spark).write(dealt.mapInArrow(run, MANIFEST), "manifest")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                draft, final = f"{root}/{row['draft']}", f"{root}/{row['file']}"
                if store.get_file_info(draft).type == pafs.FileType.File:
                    store.move(draft, final)
                if store.get_file_info(final).size != row["bytes"]:
                    raise ValueError(f"{row['file']} is not complete")
            yield batch

    moved = _each_file(written).mapInArrow(move, MANIFEST)
    moved.drop("draft").write.mode("errorifexists").parquet(f"{folder}/manifest")
    return folder


_MANIFEST_ARROW = pa.schema(
    [(n, pa.int64() if n in ("records", "bytes") else pa.string()) for n in MANIFEST.names]
)


def _each_file(manifest: DataFrame) -> DataFrame:
    """The manifest with one file a partition; it has one short row a file."""
    return manifest.coalesce(1).repartition(max(1, manifest.count()))


def read_member(source, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an open file: their headers and blocks, with the block digests tested."""
    with gzip.GzipFile(fileobj=source) as data:
        while line := data.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{name}: no record where one should begin")
            fields = {}
            while (line := data.readline()) not in (b"\r\n", b""):
                key, _, value = line.decode().rstrip("\r\n").partition(": ")
                fields[key] = value
            block = data.read(int(fields["Content-Length"]))
            if data.read(4) != b"\r\n\r\n":
                raise ValueError(f"{name}: a record is cut short")
            if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                raise ValueError(f"{name}: a block does not have its digest")
            yield fields, block


def describe(fields: dict[str, str], block: bytes) -> tuple:
    """A record as a row of RECORDS; a response's payload is measured, not believed."""
    number = lambda k: int(fields[k]) if k in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    length = number("X-Payload-Length")
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != length:
            raise ValueError(f"{fields['WARC-Record-ID']} does not have its payload digest")
    return number("X-Page-ID"), length, digest, fields["WARC-Type"], number("X-Refers-To-Page-ID")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files that the folder's manifest names, one row a page record."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        for batch in batches:
            for file, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, met = [], 0
                with store.open_input_stream(f"{root}/{file}", compression=None) as source:
                    for fields, block in read_member(source, file):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(describe(fields, block))
                        met += 1
                        if len(rows) == 4096:
                            yield _batch(rows, kinds)
                            rows = []
                if met != expected:
                    raise ValueError(f"{file} has {met} records, its manifest {expected}")
                if rows:
                    yield _batch(rows, kinds)

    manifest = spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")
    return _each_file(manifest.select("file", "records")).mapInArrow(run, RECORDS)


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=RECORDS.names)
