"""Archives: legacy ARC records, their conversion to WARC, writing and reading back.

ARC 1 heads a record with ``URL IP date type length``; ARC 2 adds result code,
checksum, location, offset and file name. Which form holds is declared by the
archive's first record, the version block. The converter takes exactly the
declared length of each record and makes up what WARC asks for: a record id
derived from the record's content and place, an ISO timestamp, a record type
and SHA-1 digests. Archives are rolled at ``ARCHIVE_BYTES``, so that neither a
writer nor a reader holds more than that and a record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import shared_path

#: Payloads below this many bytes are always stored.
LEAST_BYTES = 1000
#: An archive takes no further record once its records have this many bytes.
ARCHIVE_BYTES = 64 << 20
#: Records that are put in a legacy archive, parsed and converted at a time, and rows that a reader returns at a time.
RECORDS = 64
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "arc-to-warc")
#: Field names of the two ARC header lines.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}


@dataclass
class Record:
    """One archived document: its header fields and the bytes of its block."""

    fields: dict[str, str]
    block: bytes
    offset: int = 0
    version: int = 1
    #: The version block that opens an archive.
    opens: bool = False


def arc_version_block(version: int, name: str, date: str) -> bytes:
    """The record that opens an archive: its own header line, then version, origin and field names."""
    body = f"{version} 0 strandline\n{' '.join(ARC_FIELDS[version])}\n".encode()
    tail = f"text/plain {len(body)}" if version == 1 else f"text/plain 200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} 0.0.0.0 {date} {tail}\n".encode() + body + b"\n"


def shown_url(url: str) -> str:
    """A URL without white space, as header lines are split at spaces; an empty one is ``-``."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 else c for c in url) or "-"


def arc_record(version: int, url: str, date: str, block: bytes, mime: str = "text/html", ip: str = "0.0.0.0", name: str = "-") -> bytes:
    """One ARC record."""
    middle = f"{mime}" if version == 1 else f"{mime} 200 {hashlib.md5(block).hexdigest()} - 0 {name}"
    return f"{shown_url(url)} {ip} {date} {middle} {len(block)}\n".encode() + block + b"\n"


def is_version_block(head: bytes, block: bytes) -> bool:
    """Whether a record inside an archive opens a further one: besides the address, its block must be that of a version block.

    A page whose address begins with ``filedesc:`` is a page like any other.
    """
    lines = block.split(b"\n", 2)
    return head.startswith(b"filedesc:") and len(lines) > 1 and lines[0].split(b" ", 1)[0].isdigit() and lines[1].startswith(b"URL IP-address Archive-date ")


def read_arc(data: bytes) -> Iterator[Record]:
    """Parse an ARC archive by its header lines and declared lengths.

    The first record is the version block, which decides how many fields a
    header line has; where archives are concatenated, each further version
    block decides anew. Blank lines between records are skipped. An archive
    that does not begin with a version block, a line with another number of
    fields, a bad length or a block cut short raises ValueError.
    """
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at {at} has no end")
        parts = data[at:end].decode("utf-8").rstrip("\r").split(" ")
        begin, length = end + 1, int(parts[-1]) if parts[-1].isdecimal() and parts[-1].isascii() else -1
        block = data[begin : begin + length] if length >= 0 else b""
        opens = is_version_block(data[at:end], block)
        if not version and not opens:
            raise ValueError(f"no version block at {at}")
        if opens:
            declared = int(block.split(b" ", 1)[0])
            version = declared if declared in ARC_FIELDS else next((v for v, names in ARC_FIELDS.items() if len(names) == len(parts)), 0)
        names = ARC_FIELDS.get(version, [])
        if len(parts) != len(names) or length < 0:
            raise ValueError(f"header line at {at} is not of ARC {version}: {parts[:3]}")
        if len(block) != length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(block)} are left")
        yield Record(dict(zip(names, parts, strict=True)), block, at, version, opens)
        at = begin + length


def http_split(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP header fields (lower-case names) and the payload; a block without an HTTP head is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return {}, block
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, body


def iso(date: str) -> str:
    """ARC's YYYYMMDDhhmmss (shorter: the rest is the earliest) as WARC's timestamp."""
    d = date.ljust(14, "0") if len(date) >= 8 else date
    y, mo, da, h, mi, s = d[:4], d[4:6], d[6:8], d[8:10], d[10:12], d[12:14]
    return f"{y}-{'01' if mo == '00' else mo}-{'01' if da == '00' else da}T{h}:{mi}:{s}Z"


def record_id(record: Record, archive: str) -> str:
    """An id made of the archive's name, the record's place in it and its content: unique, and the same when a task runs again."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join([archive, str(record.offset), record.fields['URL'], record.fields['Archive-date'], hashlib.sha1(record.block).hexdigest()]))}>"


@dataclass
class Original:
    """The response that a revisit stands for."""

    page: str
    url: str
    date: str


def to_warc(record: Record, archive: str = "", original: Original | None = None) -> bytes:
    """The WARC record of an ARC record, without the closing two line ends.

    The version block becomes ``warcinfo``, HTTP answers ``response``, others
    ``resource``; with ``original`` an answer becomes a ``revisit`` whose block
    is its HTTP head, which names the original's address and date, while digest
    and length fields describe the full payload.
    """
    http, payload = http_split(record.block)
    kind = "warcinfo" if record.opens else "revisit" if original is not None else "response" if http or record.block.startswith(b"HTTP/") else "resource"
    block = record.block[: len(record.block) - len(payload)] if kind == "revisit" else record.block
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(record, archive)}", f"WARC-Date: {iso(record.fields['Archive-date'])}"]
    if record.opens:
        lines += [f"WARC-Filename: {archive or record.fields['URL'].removeprefix('filedesc://')}", "Content-Type: application/warc-fields"]
    else:
        lines += [f"WARC-Target-URI: {record.fields['URL']}", f"WARC-IP-Address: {record.fields['IP-address']}"]
        lines += [f"Content-Type: {'application/http;msgtype=response' if kind in ('response', 'revisit') else record.fields['Content-type']}"]
        lines += [f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"WARC-Refers-To-Target-URI: {shown_url(original.url)}", f"WARC-Refers-To-Date: {iso(original.date)}", f"X-Refers-To-Page: {original.page}"]
    lines += [f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block


def read_warc(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by declared lengths; a record at a time, digests are checked."""
    line = source.readline()
    while line:
        if line == b"\r\n":
            line = source.readline()
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := source.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError("a WARC header has no end")
            name, _, value = line.decode("utf-8").partition(":")
            fields[name] = value.strip()
        length = int(fields["Content-Length"])
        block = source.read(length)
        if len(block) != length or fields.get("WARC-Block-Digest", "sha1:").removeprefix("sha1:") not in ("", hashlib.sha1(block).hexdigest()):
            raise ValueError(f"WARC record {fields.get('WARC-Record-ID')} is damaged")
        yield fields, block
        line = source.readline()


def decisions(pages: DataFrame, key: str, payload: Column, url: str) -> DataFrame:
    """key, digest, refers_to and refers_url of what is stored as revisits: not the largest key of equal payloads of ``LEAST_BYTES`` bytes or more.

    Digests alone are shuffled. A payload that a third of all pages share is
    reduced before its shuffle; joining back, the adaptive planner may split it.
    """
    named = pages.select(key, F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"), url).where(f"bytes >= {LEAST_BYTES} AND {key} IS NOT NULL")
    last = named.groupBy("digest").agg(F.max(F.struct(F.col(key).alias("refers_to"), F.col(url).alias("refers_url"))).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last.*")
    return named.join(last, "digest").where(F.col(key) < F.col("refers_to")).select(key, "digest", "refers_to", "refers_url").distinct()


def write_archives(pages: DataFrame, path: str, arc_versions: tuple[int, ...] = (1, 2), archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as gzip-compressed WARC files below ``path``, a folder per archive.

    Records go through legacy ARC archives (the forms alternate), which are
    parsed and converted. A task begins a new archive once ``archive_bytes`` are
    reached. Spark's text writer puts the bytes in the files, each record closed
    by two line ends, so any file system Spark knows will do, and lost tasks are
    rerun without leaving partial files.
    """
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    found = decisions(pages, "page_id", F.col("html"), "url")
    # A page is its id and its payload: rows that repeat an id with another payload are judged by their own.
    joined = pages.withColumn("digest", F.sha1("html")).join(found, ["page_id", "digest"], "left")
    joined = joined.select(F.col("page_id").cast("string").alias("page"), "url", F.encode("html", "UTF-8").alias("payload"), F.col("refers_to").cast("string").alias("refers_to"), "refers_url")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        date, task = "20200101000000", TaskContext.get().partitionId()
        roll, size, name = -1, archive_bytes, ""
        for batch in batches:
            for k in range(0, batch.num_rows, RECORDS):
                names, out = [], []
                rows = batch.slice(k, RECORDS).to_pylist()
                while rows:
                    if size >= archive_bytes:
                        roll, size = roll + 1, 0
                        name = f"{task:06d}-{roll:06d}"
                    version = arc_versions[roll % len(arc_versions)]
                    arc = [arc_version_block(version, name, date)]
                    taken = 0
                    while taken < len(rows) and (not taken or size + sum(map(len, arc)) < archive_bytes):
                        row = rows[taken]
                        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page: {row['page'] or ''}\r\n\r\n".encode()
                        arc.append(arc_record(version, row["url"], date, head + row["payload"]))
                        taken += 1
                    records = read_arc(b"".join(arc))
                    info = next(records)
                    if not size:
                        out.append(to_warc(info, name))
                        names.append(name)
                    for row, record in zip(rows[:taken], records, strict=True):
                        record.offset += size
                        out.append(to_warc(record, name, None if row["refers_to"] is None else Original(row["refers_to"], row["refers_url"], date)))
                        names.append(name)
                    size += sum(map(len, arc))
                    rows = rows[taken:]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(names, pa.string())], names=["record", "archive"])

    warc = joined.mapInArrow(convert, "record binary, archive string").select(F.col("record").cast("string").alias("value"), "archive")
    warc.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").partitionBy("archive").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files below ``path``: page_id, record_type, payload_bytes, payload_digest, refers_to, record_id.

    A task holds one compressed archive and decompresses it record by record.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

    def page_rows(content: bytes) -> Iterator[tuple]:
        for fields, block in read_warc(gzip.open(io.BytesIO(content))):
            if fields["WARC-Type"] not in ("response", "revisit"):
                continue
            http, payload = http_split(block)
            digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
            if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
            page = http.get("x-page", "")
            yield int(page) if page else None, size, digest, fields["WARC-Type"], int(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None, fields["WARC-Record-ID"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(page_rows(content.as_py()))
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write every row of ``pages`` to WARC archives in the shared folder and read them back, a row per record.

    Null html is an empty payload; a null url is written as ``-``. Rows with a
    null page_id are responses always. Rows that repeat a page_id are judged by
    their own payloads; of equal rows with the largest id of their payload all
    are responses. Payloads of any length are kept whole; columns besides
    page_id, url and html are ignored. No pages give no rows.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).drop("record_id")


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id < last_id THEN last_id END AS refers_to
FROM m
"""
