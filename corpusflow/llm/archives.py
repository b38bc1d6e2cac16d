"""Web archives in ZIP packages: written by Spark tasks, read back by range reads.

A package holds one stored member ``archive/data.warc.gz`` (records compressed
one by one) and one stored member ``indexes/index.cdx`` (offset, length and page
id of each record). The reader parses the ZIP directories itself, central and
ZIP64, finds where the stored members lie inside the package, and reads records
by their offset and length; nothing is extracted.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import scratch_path

from .tables import cut, partitions

DATA = "archive/data.warc.gz"
INDEX = "indexes/index.cdx"
PACKAGE_BYTES = 64 << 20
READ_BYTES = 4 << 20
REVISIT_LEAST = 1000
#: Pages carry no date of capture; the format wants one.
CAPTURED = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


# --- writing

def planned_records(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """What to write: page_id, url, payload, payload_bytes, payload_digest, refers_to (null: response).

    Of equal payloads of ``least`` bytes or more the largest page_id is the
    response. Only digests and ids are grouped. Repeated rows with that id are
    all responses; in a group of null ids only, all are. A null html is the
    empty payload.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1(F.col("payload").cast("binary")).alias("payload_digest"))
    first = (rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
             .agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n"))
    other = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return rows.join(first, "payload_digest", "left").select(
        "page_id", "url", F.when(other, F.lit(None)).otherwise(F.col("payload")).alias("payload"),
        "payload_bytes", "payload_digest", F.when(other, F.col("keep")).alias("refers_to"))


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record_bytes(page_id, url, payload, size, digest, refers_to) -> bytes:
    """One record; without ``payload`` a revisit, which keeps the HTTP headers only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {CAPTURED}"]
    if url:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class PackageWriter:
    """One package, written front to back to a stream of any file system."""

    def __init__(self, folder: str):
        self.files, root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(root, recursive=True)
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.zip"  # a repeated task writes another package
        self.stream = self.files.open_output_stream(f"{root.rstrip('/')}/{self.uri.rpartition('/')[2]}")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.index, self.at, self.count = io.StringIO(), 0, 0

    def add(self, page_id: int | None, record: bytes) -> None:
        packer = zlib.compressobj(1, wbits=31)
        packed = packer.compress(record) + packer.flush()
        self.data.write(packed)
        self.index.write(f"{self.at} {len(packed)} {'-' if page_id is None else page_id}\n")
        self.at += len(packed)
        self.count += 1

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, self.index.getvalue())
        self.zip.close()
        self.stream.close()
        return self.uri, self.count, self.at


def write_packages(pages: DataFrame, folder: str, least: int = REVISIT_LEAST, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``pages`` as packages below ``folder``; one row per package: path, records, bytes.

    The rows are cut, so packages are written once; those of lost attempts are
    not listed and never read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, package = [], None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    package = package or PackageWriter(folder)
                    package.add(row[0], record_bytes(*row))
                    if package.at >= package_bytes:
                        done.append(package.close())
                        package = None
        if package:
            done.append(package.close())
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["path", "records", "bytes"])

    rows = planned_records(pages, least).withColumn("payload", F.col("payload").cast("binary"))
    return cut(rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").mapInArrow(write, "path string, records long, bytes long"))


# --- reading

@dataclass(frozen=True)
class Member:
    """A stored member: where its bytes lie inside the package."""

    name: str
    start: int
    size: int


def _directory(file, length: int) -> tuple[int, int, int]:
    """Offset, size and entry count of the central directory, by ZIP64 records where there are."""
    tail_at = max(0, length - 65_557)  # the end record and the longest comment
    tail = file.read_at(length - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0 or len(tail) - end < 22:
        raise ValueError("no end of central directory: not a ZIP package")
    entries, size, offset = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        record = file.read_at(56, at)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is not where its locator says")
        entries, size, offset = struct.unpack_from("<QQQ", record, 32)
    return offset, size, entries


def members(file, length: int) -> list[Member]:
    """Stored members of a package, by its central directory; sizes and offsets by ZIP64 fields where marked."""
    offset, size, entries = _directory(file, length)
    directory, at, out = file.read_at(size, offset), 0, []
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain = struct.unpack_from("<II", directory, at + 20)
        name_len, extra_len, comment_len = struct.unpack_from("<HHH", directory, at + 28)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_len].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = directory[at + 46 + name_len : at + 46 + name_len + extra_len], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # holds, in this order, only what is marked as too large
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            k += 4 + n
        at += 46 + name_len + extra_len + comment_len
        if method == 0 and not flags & 1:
            local = file.read_at(30, header)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header for {name}")
            out.append(Member(name, header + 30 + sum(struct.unpack_from("<HH", local, 26)), plain))
    return out


def index_entries(file, index: Member) -> list[tuple[int, int]]:
    """Offset and length of each record."""
    lines = file.read_at(index.size, index.start).decode().splitlines()
    return [(int(a), int(b)) for a, b, _ in (line.split(" ", 2) for line in lines)]


def ranges(entries: list[tuple[int, int]], most: int = READ_BYTES) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring records that one read of about ``most`` bytes covers."""
    run: list[tuple[int, int]] = []
    for offset, length in entries:
        if run and (offset != sum(run[-1]) or offset + length - run[0][0] > most):
            yield run
            run = []
        run.append((offset, length))
    if run:
        yield run


def parse_record(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; the digest of a response is checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = _page(fields["WARC-Record-ID"])
    if fields["WARC-Type"] == "revisit":
        size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        return page, size, digest, "revisit", _page(fields["WARC-Refers-To"])
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of page {page} does not have its digest")
    return page, len(payload), digest, "response", None


def read_package(uri: str) -> Iterator[list[tuple]]:
    """Parsed records of one package, a few megabytes of records at a time."""
    files, path = fs.FileSystem.from_uri(uri)
    length = files.get_file_info(path).size
    with files.open_input_file(path) as file:
        found = {m.name: m for m in members(file, length)}
        for name in (DATA, INDEX):
            if name not in found:
                raise ValueError(f"{uri} holds no stored member {name}")
        data = found[DATA]
        for run in ranges(index_entries(file, found[INDEX])):
            at = run[0][0]
            raw = file.read_at(sum(run[-1]) - at, data.start + at)
            yield [parse_record(zlib.decompress(raw[a - at : a - at + n], wbits=31)) for a, n in run]


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of the packages named by ``path``: one row each.

    Packages without records give no rows; a null path is an error, as is a
    broken package. Other columns are not read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for rows in read_package(uri):
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return packages.select("path").repartition(partitions(packages.sparkSession), "path").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages in the shared folder and read them back.

    One row per row of ``pages``: page_id, payload_bytes, payload_digest,
    record_type, refers_to. Null html is the empty payload, a null url leaves
    its header out, a null page_id comes back null; rows that repeat are
    repeated records; an empty table writes no package and gives no rows;
    other columns are not read.
    """
    return read_packages(write_packages(pages, scratch_path(pages.sparkSession, "packages"), least))
