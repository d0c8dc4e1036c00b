"""Legacy archive converter: ARC files to equivalent WARC files.

An archive is one binary value (a file of gzip members, one per record) in a table of
(``archive``, ``payload``); whole tasks are committed, so a lost executor leaves no half
file. The converter reads the version block of each ARC file to learn its header-line fields
(five in version 1, ten in version 2), then parses header lines and declared lengths record by
record. Each record becomes a WARC/1.1 record with a synthesised identifier, ISO timestamp,
type, IP address and SHA-1 block and payload digests. The version block becomes a warcinfo record,
a block that begins with an HTTP status line a response, whatever the scheme of its url, whose payload
follows its head (which ends at the first empty line, with or without carriage returns), anything else
(dns, ftp, an answer without HTTP head) a resource of the ARC content type whose payload is the whole block.

Records of one type and of equal payloads of at least ``min_bytes`` bytes are stored once: the one with the
largest page id is the response (of rows that share it, the last in archive order), the
others become revisit records without payload that refer to its record id. Digests are gathered first
(narrow rows); the choice is an aggregate and a join on the digest, and only the revisits
found travel back to their archives, so payloads cross the network once at most.

Defined cases: texts of any length are one record each, and ``write_arc`` starts a new archive after
``ARCHIVE_BYTES``; an archive is held whole by one task, so it must fit a cell (2 GB); a null payload is empty, a null url becomes ``about:blank``, blanks and control
characters in a url are percent-encoded, a null id is kept as null and loses to every other;
repeated rows are records of their own; a damaged archive fails with its name; an empty
table gives no archives and an empty result; other columns are not written.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import materialize

FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARCHIVE = "archive string, payload binary"
ARCHIVE_BYTES = 8_000_000
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")   # the RFC 4122 name space of URLs
STATUS_LINE = re.compile(rb"HTTP/\d(\.\d+)? \d{3}[ \r\n]")
END_OF_HEAD = re.compile(rb"\r?\n\r?\n")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(data: bytes) -> bytes:
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def members(data: bytes, step: int = 8192) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(data):
                raise ValueError("an archive ends inside a member")
            parts.append(inflate.decompress(data[at:at + step]))
            at = min(at + step, len(data))
        at -= len(inflate.unused_data)
        yield b"".join(parts)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean_url(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode())
                   for c in (url or "")) or "about:blank"


def http_block(page: int | None, body: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\n"
    return f"{head}Content-Length: {len(body)}\r\n\r\n".encode() + body


def split_head(block: bytes) -> tuple[bytes, bytes]:
    """A block up to and with its first empty line, and what follows."""
    end = END_OF_HEAD.search(block)
    return (block[:end.end()], block[end.end():]) if end else (block, b"")


def headers(block: bytes, encoding: str = "latin-1") -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) after the first line of a block, and what follows them."""
    head, rest = split_head(block)
    pairs = (line.partition(":") for line in head.decode(encoding).replace("\r\n", "\n").split("\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k.strip()}, rest


def split_block(block: bytes) -> tuple[str, bytes, bytes]:
    """WARC type, HTTP head and payload of an ARC record: what a record is follows from its block, as
    its url may be of any scheme."""
    return ("response", *split_head(block)) if STATUS_LINE.match(block) else ("resource", b"", block)


def text_of(line: bytes) -> str:
    try:
        return line.decode()
    except UnicodeDecodeError:
        return line.decode("latin-1")


def arc_head(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 converter\n{FIELDS[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain "
    line += "" if version == 1 else f"200 - - 0 {name} "
    return f"{line}{len(body)}\n".encode() + body


def arc_record(version: int, name: str, url: str, date: str, block: bytes, offset: int) -> bytes:
    line = f"{url} 0.0.0.0 {date} text/html "
    if version == 2:
        line += f"200 {base32_sha1(block)} - {offset} {name} "
    return f"\n{line}{len(block)}\n".encode() + block


def arc_parts(name: str, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (by the names of the file's own version block) and network document of each
    record; of a version block ``filedesc`` (its header line), URL, IP-address and Archive-date."""
    names: list[str] = []
    for one in members(data):
        at = 0
        while at < len(one):
            if one[at:at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = one.index(b"\n", at)
            line = text_of(one[at:end]).rstrip("\r")
            size = int(line.rsplit(" ", 1)[1])
            body = one[end + 1:end + 1 + size]
            at = end + 1 + size
            if len(body) < size:
                raise ValueError(f"{name}: a record ends before its declared length")
            values = line.split(" ")
            if not names or line.startswith("filedesc://") and not STATUS_LINE.match(body):
                version = int(body.split(b" ", 1)[0])
                names = text_of(body.split(b"\n")[1]).rstrip("\r").split(" ")
                if names != FIELDS.get(version, "").split(" "):
                    raise ValueError(f"{name}: unknown header line for version {version}")
                yield {"filedesc": line} | dict(zip(names[:3], values, strict=False)), body
                continue
            if len(values) != len(names):
                raise ValueError(f"{name}: a header line has {len(values)} fields")
            yield dict(zip(names, values, strict=True)), body


def arc_records(name: str, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of ``arc_parts`` without version blocks."""
    return ((fields, block) for fields, block in arc_parts(name, data) if "filedesc" not in fields)


def warc_date(fields: dict[str, str]) -> str:
    d = fields["Archive-date"]
    d += "00000101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(fields: dict[str, str], name: str, position: int) -> str:
    return str(uuid.uuid5(NAMESPACE, f"{name} {position} {fields['URL']} {fields['Archive-date'].ljust(14, '0')}"))


def whole_record(lines: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_info(fields: dict[str, str], block: bytes, name: str, to: str) -> bytes:
    """The warcinfo record of a version block; its lines are kept."""
    info = ["software: ledgerlens", "format: WARC File Format 1.1", f"arc-name: {name}", f"arc-filedesc: {fields['filedesc']}"]
    info += [f"arc-header: {x}" for x in text_of(block).splitlines() if x.strip()]
    block = "".join(f"{x}\r\n" for x in info).encode()
    return whole_record(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{record_id(fields, name, -1)}>",
                         f"WARC-Date: {warc_date(fields)}", f"WARC-Filename: {to}",
                         f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/warc-fields"], block)


def warc_record(fields: dict[str, str], block: bytes, name: str, position: int, refers: int | None, revisit: bool,
                refers_to: str | None = None) -> bytes:
    kind, head, payload = split_block(block)
    digest = base32_sha1(payload)
    if revisit:
        block = head
    content = "application/http;msgtype=response" if kind == "response" else fields["Content-type"]
    lines = [f"WARC-Type: {'revisit' if revisit else kind}", f"WARC-Record-ID: <urn:uuid:{record_id(fields, name, position)}>",
             f"WARC-Date: {warc_date(fields)}", f"WARC-Target-URI: {fields['URL']}", f"WARC-IP-Address: {fields['IP-address']}",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
             f"Content-Type: {content}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"Refers-To-Page-Id: {'' if refers is None else refers}",
                  f"Payload-Length: {len(payload)}"]
        lines += [f"WARC-Refers-To: <urn:uuid:{refers_to}>"] if refers_to else []
    return whole_record(lines, block)


def warc_records(name: str, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for one in members(data):
        fields, rest = headers(one, "utf-8")
        size = int(fields["content-length"])
        if not one.startswith(b"WARC/") or len(rest) != size + 4:
            raise ValueError(f"{name}: damaged record")
        yield fields, rest[:size]


def write_arc(pages: DataFrame, path: str, date: str = "20000101000000") -> None:
    """Write the rows of ``pages`` (``page_id``, ``url``, ``html``) as ARC files, versions 1 and 2
    in turn, to the table at ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, size, offset = TaskContext.get().partitionId(), 0, [], 0, 0
        for batch in batches:
            for page, url, html in zip(*(c for c in batch.columns), strict=True):
                version, name = 1 + number % 2, f"part-{part:06d}-{number:06d}.arc.gz"
                if not out:
                    out.append(member(arc_head(name, version, date)))
                    offset = len(out[0])
                block = http_block(page.as_py(), html.as_py() or b"")
                out.append(member(arc_record(version, name, clean_url(url.as_py()), date, block, offset)))
                offset += len(out[-1])
                size += len(block)
                if size >= ARCHIVE_BYTES:
                    yield row(name, out)
                    number, out, size = number + 1, [], 0
        if out:
            yield row(name, out)
    (pages.select("page_id", "url", F.col("html").cast("binary")).mapInArrow(run, ARCHIVE)
     .write.option("compression", "none").parquet(path))


def row(name: str, out: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([b"".join(out)], pa.binary())],
                                      ["archive", "payload"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The archive files at ``path`` as a table for ``convert`` or ``read_warc``; an archive's name is its whole path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("payload"))


def page_of(text: str) -> int | None:
    return int(text) if re.fullmatch(r"-?[0-9]{1,19}", text) and -2 ** 63 <= int(text) < 2 ** 63 else None


def payloads(archives: DataFrame) -> DataFrame:
    """archive, position, page_id, payload_bytes, payload_digest, type and record id of every ARC record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for k, (fields, block) in enumerate(arc_records(name, data.as_py())):
                    kind, head, body = split_block(block)
                    rows.append((name, k, page_of(headers(head)[0].get("x-page-id", "")), len(body), base32_sha1(body),
                                 kind, record_id(fields, name, k)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, (
                        pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)],
                    ["archive", "position", "page_id", "payload_bytes", "payload_digest", "kind", "record_id"])
    return archives.select("archive", "payload").mapInArrow(
        run, "archive string, position int, page_id long, payload_bytes long, payload_digest string, kind string, record_id string")


def revisits(found: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(archive, revisits): positions that become revisits, each with the page and record it refers to."""
    equal = found.where(F.col("payload_bytes") >= min_bytes)
    first = materialize(equal.groupBy("payload_digest", "kind").agg(
        F.count("*").alias("n"), F.max(F.struct("page_id", "archive", "position", "record_id")).alias("w"))
        .where("n > 1").select("payload_digest", "kind", "w"), "responses")
    others = equal.join(first, ["payload_digest", "kind"]).where(
        (F.col("archive") != F.col("w")["archive"]) | (F.col("position") != F.col("w")["position"]))
    return others.groupBy("archive").agg(F.collect_list(
        F.struct("position", F.col("w")["page_id"].alias("page_id"),
                 F.col("w")["record_id"].alias("record_id"))).alias("revisits"))


def convert(archives: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write the WARC files of the ARC files ``archives`` to the table at ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, found in zip(*batch.columns, strict=True):
                name = name.as_py()
                refers = {x["position"]: (x["page_id"], x["record_id"]) for x in found.as_py() or []}
                to, out, k = name.replace(".arc", ".warc"), [], 0
                for fields, block in arc_parts(name, data.as_py()):
                    if "filedesc" in fields:
                        out.append(member(warc_info(fields, block, name, to)))
                        continue
                    page, record = refers.get(k, (None, None))
                    out.append(member(warc_record(fields, block, name, k, page, k in refers, record)))
                    k += 1
                yield row(to, out)
    found = materialize(payloads(archives), "arc-payloads")
    again = materialize(revisits(found, min_bytes), "revisits")
    (archives.join(again, "archive", "left").select("archive", "payload", "revisits").mapInArrow(run, ARCHIVE)
     .write.option("compression", "none").parquet(path))


def read_warc(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of every record but warcinfo."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for fields, block in warc_records(name, data.as_py()):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    http, body = headers(block) if fields["content-type"].startswith("application/http") else ({}, block)
                    rows.append((page_of(http.get("x-page-id", "")), fields["warc-target-uri"],
                                 int(fields.get("payload-length", len(body))), fields["warc-payload-digest"].removeprefix("sha1:"),
                                 fields["warc-type"], page_of(fields.get("refers-to-page-id", ""))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)
    return archives.select("archive", "payload").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
