"""WARC records in ZIP-packaged archives: a writer, and a reader that takes records by ranges.

An archive is a ZIP file whose members are stored, not compressed: archive/data.warc.gz (one gzip member for each record)
and indexes/index.cdxj (one line for each record with its place).  The reader parses the end of central directory, its
ZIP64 form and the central directory, finds the members' bytes by their local headers, and reads each record by a
range of the archive, without extraction.

Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is a response, the others
are revisits that refer to it and carry its digest and length but no payload.

Scale: digests are made in the JVM and meet in a shuffle of small rows (pre-aggregated, so a payload that a third of all pages
share is a row for each task), pages meet their role in one shuffle, each task writes archives of bounded size under names of
its own and hands on only their paths; archives are read by as many tasks as there are archives, READERS at most; a lost
executor's archives are written again and the old ones are referred to by nothing.

Defined cases: a null html is an empty payload, a null url is empty; a very long html is one record, in an archive that ends with
it; of rows with equal payload and equal smallest page_id all are responses; a null page_id comes after all others; extra
columns are not read, so their names don't matter; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept, shared_folder, short_batches

#: Bytes of records after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: The most tasks that read archives.
READERS = 100_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A revisit's profile and the date of all records, so that reruns write the same bytes.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return fs.LocalFileSystem(), path


# --- records


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with a response or revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _page(urn: str | None) -> int | None:
    inner = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def parse_record(raw: bytes) -> dict:
    """The fields of a record; payload is None for a revisit."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload": None if revisit else payload,
        "payload_bytes": length if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else payload_digest(payload),
        "refers_to": _page(fields.get("WARC-Refers-To")),
    }


# --- the ZIP container


class Archive:
    """Members of a ZIP file, by ranges."""

    def __init__(self, source) -> None:
        """source: a file with seek, read and size()."""
        self.file, self.size = source, source.size()
        self.members = {name: (offset, size, method) for name, offset, size, method in self._directory()}

    def read(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _directory(self) -> Iterator[tuple[str, int, int, int]]:
        tail_at = max(0, self.size - 22 - 65535)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        _, _, _, _, count, length, offset, _ = struct.unpack("<4s4H2LH", tail[end : end + 22])
        if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            locator = self.read(tail_at + end - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                (place,) = struct.unpack("<Q", locator[8:16])
                record_ = self.read(place, 56)
                if record_[:4] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end of central directory")
                count, length, offset = struct.unpack("<3Q", record_[32:56])
        data, at = self.read(offset, length), 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, size, n, extra, comment = struct.unpack("<H8x2L3H", data[at + 10 : at + 34])
            (header,) = struct.unpack("<L", data[at + 42 : at + 46])
            name = data[at + 46 : at + 46 + n].decode()
            fields, more = data[at + 46 + n : at + 46 + n + extra], 0
            while more + 4 <= len(fields):
                kind, width = struct.unpack("<2H", fields[more : more + 4])
                if kind == 1:  # 64-bit values of those that are full, in this order
                    wide, p = fields[more + 4 : more + 4 + width], 0
                    if size == 0xFFFFFFFF:
                        size, p = struct.unpack("<Q", wide[p : p + 8])[0], p + 8
                    if packed == 0xFFFFFFFF:
                        packed, p = struct.unpack("<Q", wide[p : p + 8])[0], p + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack("<Q", wide[p : p + 8])[0]
                more += 4 + width
            yield name, header, packed, method
            at += 46 + n + extra + comment

    def start(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many they are."""
        header, size, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; ranges need a stored member")
        local = self.read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        n, extra = struct.unpack("<2H", local[26:30])
        return header + 30 + n + extra, size

    def records(self) -> Iterator[dict]:
        """All records by the indexes' lines."""
        for name in sorted(x for x in self.members if x.startswith("indexes/") and x.endswith(".cdxj")):
            at, size = self.start(name)
            lines = self.read(at, size).decode().splitlines()
            starts = {}
            for line in lines:
                entry = json.loads(line.split(" ", 2)[2])
                if entry["filename"] not in starts:
                    starts[entry["filename"]] = self.start(entry["filename"])[0]
                yield parse_record(self.read(starts[entry["filename"]] + int(entry["offset"]), int(entry["length"])))


class _Out:
    """A write-only stream with a position, as zipfile takes it."""

    def __init__(self, stream) -> None:
        self.stream, self.at = stream, 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


def write_archive(stream, rows: Iterator[tuple], most: int = ARCHIVE_BYTES) -> int:
    """Writes records (the arguments of ``record``) to a new archive until it is full; returns their number."""
    index, at, n = [], 0, 0
    with zipfile.ZipFile(_Out(stream), "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as out:
            for args in rows:
                raw = record(*args)
                out.write(raw)
                where = json.dumps({"filename": DATA, "offset": at, "length": len(raw), "digest": args[3]})
                index.append(f"{' '.join(args[1].split()).replace(' ', '%20') or '-'} 20000101000000 {where}\n")
                at, n = at + len(raw), n + 1
                if at >= most:
                    break
        with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as out:
            out.write("".join(index).encode())
    return n


# --- over tables

def write(pages: DataFrame, folder: str | None = None, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes page_id, url and html of all pages to archives in a shared folder; returns their path and number of records."""
    short_batches(pages.sparkSession)
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    digest = F.sha1(F.coalesce("html", F.lit(""))).alias("digest")  # hexadecimal here, base 32 in the records
    whole = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", digest)
    roles = kept(whole.select("page_id", "digest", F.coalesce(F.octet_length("html"), F.lit(0)).alias("size")).distinct(), "digests")
    first = kept(roles.groupBy("digest").agg(F.min("page_id").alias("first")), "first-pages")  # as a table, so that a join may split a hot digest
    roles = roles.join(first, "digest").select(
        F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first", ((F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit")
    )
    dealt = whole.join(roles, whole["page_id"].eqNullSafe(roles["_page"]) & (whole["digest"] == roles["_digest"])).select("page_id", "url", "html", "digest", "first", "revisit")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for page, url, html, digest, first_, revisit in zip(*(batch.column(i) for i in range(6)), strict=True):
                    own = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                    yield page.as_py(), url.as_py() or "", (html.as_py() or "").encode(), own, first_.as_py(), revisit.as_py()

        left = rows()
        while (one := next(left, None)) is not None:
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            system, inner = file_system(path)
            system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(inner) as stream:
                n = write_archive(stream, itertools.chain([one], left), archive_bytes)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return kept(dealt.mapInArrow(task, "path string, records bigint"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (column path): page_id, url, record_type, payload, payload_bytes, payload_digest and refers_to."""
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = file_system(path)
                with system.open_input_file(inner) as source:
                    part, size = [], 0
                    for r in Archive(source).records():
                        part.append(r)
                        size += r["payload_bytes"]
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in part], k) for c, k in zip(names, kinds, strict=True)], names)
                            part, size = [], 0
                    if part:
                        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in part], k) for c, k in zip(names, kinds, strict=True)], names)

    schema = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"
    paths = archives.select("path").distinct()
    spread = paths.repartition(max(1, min(READERS, paths.count())))  # a number, so that small rows aren't gathered in one task
    return spread.mapInArrow(task, schema)
