"""Legacy archive converter: ARC records become WARC records, written and read as archives.

ARC files open with a version block that names the version and the fields of its header lines;
records follow, each a header line, a body of the declared length and a line feed. The converter
parses header lines by the file's own version (1: five fields, 2: ten), takes bodies by declared
length, and synthesises what WARC wants: record identifiers (a name-based UUID of target, date
and payload digest), ISO timestamps, record types and SHA-256 digests.

Archives are written by Spark's text writer with the record terminator as line separator, so each
part file is a plain WARC file wherever Spark can write; they are read back whole, by declared
length. A task begins a new file after about ``FILE_BYTES``, which bounds a reading task, and no file
has more than ``RECORDS_PER_FILE`` records. Revisits name the record they refer to by identifier, URI
and date.

Defined cases: null url becomes ``urn:none``; white space in a url is percent-encoded; null html
is an empty payload; a date that does not parse becomes the epoch; rows that tie on page_id and
payload are all responses; a null page_id never refers and, if alone, is a response; an empty
table writes no records; of pages that share the smallest page_id and a payload, the one with the least
url is referred to; a payload of any length is one record, and may be a file by itself; columns that
are not asked for are ignored, whatever their names. A declared length that runs past the end raises
``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm.common import arrow_map, by_size

#: Field names of ARC header lines by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
CRLF = b"\r\n"
TERMINATOR = CRLF * 2
RECORDS_PER_FILE = 2000
FILE_BYTES = 64_000_000
DATE = "20200101000000"
MIN_REVISIT_BYTES = 100


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes
    version: int


def write_arc(records: Iterable[tuple[str, str, str, str, bytes]], version: int = 1, name: str = "legacy.arc") -> bytes:
    """An ARC file of (url, ip, 14-digit date, mime, body) records."""
    fields = ARC_FIELDS[version]
    about = f"{version} 0 lexaudit\n{' '.join(fields)}\n".encode()

    def line(url: str, ip: str, date: str, mime: str, length: int) -> bytes:
        extra = ["200", "-", "-", "0", name] if version == 2 else []
        return (" ".join([url, ip, date, mime, *extra, str(length)]) + "\n").encode()

    out = [line(f"filedesc://{name}", "0.0.0.0", "19960101000000", "text/plain", len(about)), about, b"\n"]
    for url, ip, date, mime, body in records:
        out += [line(url, ip, date, mime, len(body)), body, b"\n"]
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, without its version block."""
    at, fields, version = 0, ARC_FIELDS[1], 1
    while at < len(data):
        if data[at] in b"\r\n":  # between records
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if line.startswith("filedesc://"):
            length = int(line.rpartition(" ")[2])
            about = data[end + 1 : end + 1 + length].split(b"\n")
            version = int(about[0].split(b" ")[0])
            fields = tuple(about[1].decode().split()) if len(about) > 1 and about[1].strip() else ARC_FIELDS[version]
            at = end + 1 + length
            continue
        values = dict(zip(fields, line.rsplit(" ", len(fields) - 1), strict=True))
        length = int(values["Archive-length"])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"record at byte {at} declares {length} bytes, {len(body)} are left")
        yield ArcRecord(values["URL"], values["IP-address"], values["Archive-date"], values["Content-type"], body, version)
        at = end + 1 + length


def http_payload(body: bytes) -> tuple[bytes, bytes]:
    """Header block (empty if the body isn't an HTTP response) and payload."""
    if body.startswith(b"HTTP/"):
        head, mark, rest = body.partition(TERMINATOR)
        if mark:
            return head + mark, rest
    return b"", body


def iso_date(date: str) -> str:
    m = re.fullmatch(r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)", date)
    return "{}-{}-{}T{}:{}:{}Z".format(*m.groups()) if m else "1970-01-01T00:00:00Z"


def record_id(url: str, date: str, digest: str, page: str = "") -> str:
    """A name-based identifier: the same record has the same one whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}|{date}|{digest}|{page}')}>"


def to_warc(record: ArcRecord, extra: dict[str, str] | None = None, refers_to: str | None = None, refers_url: str | None = None) -> bytes:
    """The WARC record of an ARC record, without its terminator. A revisit (of the page ``refers_to`` at
    ``refers_url``, with the same date and payload) keeps headers only."""
    head, payload = http_payload(record.body)
    digest = hashlib.sha256(payload).hexdigest()
    block = head if refers_to is not None else record.body
    kind = "revisit" if refers_to is not None else "response" if head else "resource"
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(record.url, record.date, digest, (extra or {}).get("X-Page-Id", "")),
        "WARC-Target-URI": record.url,
        "WARC-Date": iso_date(record.date),
        "WARC-IP-Address": record.ip,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http;msgtype=response" if head else record.mime,
        "Content-Length": str(len(block)),
        "X-Payload-Length": str(len(payload)),
    } | (extra or {})
    if refers_to is not None:
        fields |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": record_id(refers_url or "", record.date, digest, refers_to),
            "WARC-Refers-To-Target-URI": refers_url or "",
            "WARC-Refers-To-Date": iso_date(record.date),
            "X-Refers-To-Page": refers_to,
        }
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + lines.encode() + CRLF + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by declared length."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(TERMINATOR, at)
        lines = data[at:end].decode().split("\r\n")[1:]
        fields = dict(line.split(": ", 1) for line in lines)
        start, length = end + 4, int(fields["Content-Length"])
        if data[start + length : start + length + 4] != TERMINATOR:
            raise ValueError(f"record at byte {at} doesn't end after {length} bytes")
        yield fields, data[start : start + length]
        at = start + length + 4


def _clean_url(url: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "urn:none"


def _to_records(file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = count = 0
        for n, batch in enumerate(batches):
            for part in by_size(batch, "html", 1_000_000):
                some = part.to_pylist()
                legacy = []
                for r in some:
                    payload = (r["html"] or "").encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    legacy.append((_clean_url(r["url"]), "0.0.0.0", DATE, "text/html", head + payload))
                arc = write_arc(legacy, version=1 + (n + count) % 2)
                out, files = [], []
                for r, record in zip(some, parse_arc(arc), strict=True):
                    refers = None if r["refers_to"] is None else str(r["refers_to"])
                    page = "" if r["page_id"] is None else str(r["page_id"])
                    out.append(to_warc(record, {"X-Page-Id": page}, refers, _clean_url(r["refers_url"])).decode())
                    files.append(size // file_bytes)
                    size += len(record.body)
                    count += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(files, pa.int32())], ["value", "file"])

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for each page (``page_id``, ``url``, ``html``) to WARC files under ``path``.

    Digests that several pages share are written to a table first: if its files turn out small,
    the planner broadcasts it and no payload is shuffled."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    shared = f"{path}-shared"
    (
        keyed.filter(F.octet_length("html") >= min_bytes)
        .groupBy(F.col("digest").alias("d"))
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("d", F.col("first.page_id").alias("first"), F.col("first.url").alias("refers_url"))
        .write.parquet(shared)
    )
    firsts = pages.sparkSession.read.parquet(shared)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    joined = keyed.join(firsts, F.col("digest") == F.col("d"), "left").select("page_id", "url", "html", refers.alias("refers_to"), "refers_url")
    (
        arrow_map(joined, _to_records(file_bytes), "value string, file int")
        .write.partitionBy("file")
        .mode("errorifexists")
        .option("lineSep", TERMINATOR.decode())
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


_READ = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("url", pa.string())]
)


def _from_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            out = []
            for fields, block in parse_warc(content.as_py()):
                claimed = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(fields["X-Payload-Length"])
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit:
                    _, payload = http_payload(block)
                    if len(payload) != size or hashlib.sha256(payload).hexdigest() != claimed:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page")
                out.append((int(page) if page else None, size, claimed, fields["WARC-Type"], int(refers) if refers else None, fields["WARC-Record-ID"], fields["WARC-Target-URI"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _READ.types, strict=True)], schema=_READ)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under ``path``; payloads are held against their digests."""
    files = spark.read.format("binaryFile").load(path).select("content")
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string"
    return arrow_map(files, _from_files, kind)
