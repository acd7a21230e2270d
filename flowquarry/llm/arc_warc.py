"""Legacy web archives (ARC) converted to WARC.

An ARC file starts with a version block that names the fields of its record lines:

    version 1   URL IP-address Archive-date Content-type Archive-length
    version 2   URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

Each record is such a line, as many bytes as it declares and a line end. The converter reads the lines by the
version of their file and writes a WARC/1.1 record for each: an identifier that follows from the archive's
name and the record's number, the date in ISO form, the type, and SHA-1 digests of block and payload. Of
records with equal payloads of at least ``min_bytes`` bytes, the one with the largest page id (of equal ids the
first in the archives) becomes a response; the others become revisits, which keep their HTTP header but not the payload.

Payloads stay in the task that reads their archive: only (file, record, page id, digest) is shuffled, summed up
by digest before. Records may be gzip members or plain. Nulls count as empty pages; a null URL is written as
``urn:page``, white space and control characters of URLs are percent-encoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch_path
from .common import CommittedFile, drop_paths, locate, map_arrow, parallelism, written

FIELDS = {  # fixed values: the record lines of the two versions
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
        "Archive-length"],
}
ARCHIVE_BYTES = 64 << 20
NO_DATE = "19700101000000"


@dataclass(frozen=True)
class ArcRecord:
    number: int
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes

    def http(self) -> tuple[bytes, bytes]:
        """HTTP header (with its blank line) and payload; a block without HTTP header is all payload."""
        if self.block.startswith(b"HTTP/"):
            head, mark, payload = self.block.partition(b"\r\n\r\n")
            if mark:
                return head + mark, payload
        return b"", self.block

    def page_id(self) -> int | None:
        for line in self.http()[0].split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"x-page-id":
                return int(value)
        return None


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _url(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace"))
                   for c in url) if url else "urn:page"


class ArcWriter:
    def __init__(self, uri: str, version: int = 1):
        self._file, self._version = CommittedFile(uri), version
        fields = (" ".join(FIELDS[version]) + "\n").encode()
        block = f"{version} 0 none\n".encode() + fields
        self.size, self.records = 0, 0
        self.add(f"filedesc://{uri.rpartition('/')[2]}", "0.0.0.0", NO_DATE, "text/plain", block)
        self.records = 0

    def add(self, url: str, ip: str, date: str, content_type: str, block: bytes) -> None:
        middle = {1: "", 2: f" 200 {hashlib.md5(block).hexdigest()} - {self.size} -"}[self._version]
        line = f"{url} {ip} {date} {content_type}{middle} {len(block)}\n".encode("utf-8", "replace")
        data = _member(line + block + b"\n")
        self._file.write(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> None:
        self._file.commit()


def _plain(stream) -> gzip.GzipFile:
    start = stream.read(2)
    stream.seek(0)
    return gzip.GzipFile(fileobj=stream) if start == b"\x1f\x8b" else stream


def _line(stream) -> bytes:
    return stream.readline()


def read_arc(uri: str) -> Iterator[ArcRecord]:
    """Records of one archive, without its version block; a record shorter than it declares is an error."""
    fs, path = locate(uri)
    with fs.open_input_file(path) as raw:
        stream = _plain(raw)
        fields, number = None, 0
        while line := _line(stream):
            if not line.strip():
                continue
            words = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
            size = int(words[-1])
            block = stream.read(size)
            if len(block) != size:
                raise ValueError(f"{uri}: record {number} has {len(block)} of {size} bytes")
            if fields is None:
                if not words[0].startswith("filedesc://"):
                    raise ValueError(f"{uri}: no version block")
                version = int(block.split(None, 1)[0])
                if version not in FIELDS:
                    raise ValueError(f"{uri}: version {version}")
                fields = FIELDS[version]
                continue
            if len(words) < len(fields):
                raise ValueError(f"{uri}: record {number} has {len(words)} of {len(fields)} fields")
            of = dict(zip(fields, words))
            yield ArcRecord(number, of["URL"], of["IP-address"], of["Archive-date"], of["Content-type"], block)
            number += 1


def write_arc(pages: DataFrame, path: str, version: int = 1) -> DataFrame:
    """Pages (page_id, url, html) as ARC files below ``path``; one row (file, n_records) a file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, out = TaskContext.get().partitionId(), [], None

        def close():
            out.close()
            made.append((name, out.records))

        for batch in batches:
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if out is None:
                    name = f"{path}/pages-{part:06d}-{len(made):04d}.arc.gz"
                    out = ArcWriter(name, version)
                payload = (html or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                head += f"X-Page-ID: {page}\r\n" if page is not None else ""
                out.add(_url(url), "0.0.0.0", NO_DATE, "text/html", (head + "\r\n").encode() + payload)
                if out.size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())],
                                         names=["file", "n_records"])

    rows = map_arrow(pages.selectExpr("CAST(page_id AS bigint) AS page_id", "url", "html"), run, "file string, n_records long")
    return written(rows, "arc-manifest")[0]


def _record_id(arc: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{arc.rpartition('/')[2]}#{number}')}>"


def _iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(arc: str, record: ArcRecord, original: tuple | None) -> bytes:
    """WARC record of an ARC record; ``original`` (arc, number, page id) makes it a revisit."""
    head, payload = record.http()
    block = head if original else record.block
    kind = "revisit" if original else "response" if head else "resource"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(arc, record.number)}",
             f"WARC-Date: {_iso(record.date)}", f"WARC-Target-URI: {record.url}",
             f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
             f"Content-Type: {'application/http; msgtype=response' if head else record.content_type}"]
    if record.ip != "0.0.0.0":
        lines.append(f"WARC-IP-Address: {record.ip}")
    if original:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_record_id(original[0], original[1])}", f"X-Payload-Length: {len(payload)}"]
        if original[2] is not None:
            lines.append(f"X-Refers-To-Page-ID: {original[2]}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(spark: SparkSession, arcs: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """WARC files below ``path`` from ARC files (column ``file``), one for each; one row (file, n_records) a file."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = [(name, r.number, r.page_id(), digest(p := r.http()[1]), len(p)) for r in read_arc(name)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5,
                                                    (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))],
                    names=["file", "number", "page_id", "digest", "size"])

    n = parallelism(spark)
    files = arcs.select("file").repartition(n)
    rows, rows_path = written(map_arrow(files, index, "file string, number long, page_id long, digest string, size long")
                              .where(F.col("size") >= min_bytes), "arc-index")
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("to_page")).where("n > 1")
    r, g = rows.alias("r"), groups.alias("g")
    firsts, firsts_path = written(  # joined by digest and page id, so copies of one payload spread over all tasks
        g.join(r, F.expr("g.digest = r.digest AND g.to_page <=> r.page_id"))
        .groupBy("g.digest", "g.to_page").agg(F.min(F.struct("r.file", "r.number")).alias("o"))
        .select("digest", "to_page", F.col("o.file").alias("to_file"), F.col("o.number").alias("to_number")), "arc-firsts")
    revisits, revisits_path = written(
        rows.join(firsts, "digest").where("NOT (file = to_file AND number = to_number)")
        .groupBy("file").agg(F.collect_list(F.struct("number", "to_file", "to_number", "to_page")).alias("revisits")), "arc-revisits")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for name, listed in zip(batch.column("file").to_pylist(), batch.column("revisits").to_pylist()):
                originals = {r["number"]: (r["to_file"], r["to_number"], r["to_page"]) for r in listed or ()}
                target = f"{path}/{name.rpartition('/')[2].removesuffix('.gz').removesuffix('.arc')}.warc.gz"
                out, count = CommittedFile(target), 0
                for record in read_arc(name):
                    out.write(_member(warc_record(name, record, originals.get(record.number))))
                    count += 1
                out.commit()
                made.append((target, count))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())],
                                             names=["file", "n_records"])

    done = written(map_arrow(files.join(revisits, "file", "left").select("file", "revisits").repartition(n), rewrite,
                             "file string, n_records long"), "warc-manifest")[0]
    drop_paths(spark, [rows_path, firsts_path, revisits_path])
    return done


def read_warc_file(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of one archive."""
    fs, path = locate(uri)
    with fs.open_input_file(path) as raw:
        stream = _plain(raw)
        while line := _line(stream):
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{uri}: no record where one should start")
            fields: dict[str, str] = {}
            while (line := _line(stream)).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip()] = value.strip()
            yield fields, stream.read(int(fields["Content-Length"]))


def read_warc(spark: SparkSession, warcs: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, uri and date of all records.

    A payload that doesn't match its digest is an error.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "uri", "date"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                for fields, block in read_warc_file(name):
                    record = ArcRecord(0, "", "", "", "", block)
                    payload, kind = record.http()[1], fields["WARC-Type"]
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind != "revisit" and digest(payload) != said:
                        raise ValueError(f"{name}: {fields['WARC-Record-ID']} does not match its digest")
                    to = fields.get("X-Refers-To-Page-ID")
                    rows.append((record.page_id(), int(fields.get("X-Payload-Length", len(payload))), said, kind,
                                 int(to) if to else None, fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

    return map_arrow(warcs.select("file").repartition(parallelism(spark)), run,
                     "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                     "record_id string, uri string, date string")


def round_trip(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages written as ARC files, converted to WARC files and read back."""
    spark = pages.sparkSession
    arcs = write_arc(pages, scratch_path(spark, "arc"), version)
    return read_warc(spark, convert(spark, arcs, scratch_path(spark, "warc")))
