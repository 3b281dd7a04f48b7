"""Web archives: ARC records by version and declared length, converted to WARC, written to and read from the shared folder."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.llm.shared import Scope, column_bytes, mapped, new_path

#: Header lines of the two ARC versions (fixed values of the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes of records that are written as one row, a record at least, and such rows of a file: a file holds the product, or twelve of
#: the largest records if they are larger.
PACK_BYTES, FILE_PACKS = 2_000_000, 12
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes
    version: int = 1
    more: dict[str, str] = field(default_factory=dict)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_file(records: list[ArcRecord], version: int = 1, date: str = "20260101000000", name: str = "pages.arc") -> bytes:
    """An ARC file: the version block that names the fields, then each record under its header line."""
    intro = f"{version} 0 lexisift\n{ARC_FIELDS[version]}\n\n".encode()
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(intro)}\n".encode(), intro, b"\n"]
    at = sum(map(len, out))
    for r in records:
        extra = "" if version == 1 else f" {r.more.get('Result-code', '200')} {r.more.get('Checksum', '-')} {r.more.get('Location', '-')} {at} {name}"
        head = f"{_UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', r.url) or '-'} {r.ip} {r.date} {r.mime}{extra} {len(r.body)}\n".encode()
        out += [head, r.body, b"\n"]
        at += len(head) + len(r.body) + 1
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file of either version, by their declared lengths; the version block sets the fields and isn't returned.

    A header line is read from its right end, so a URL may hold spaces. A wrong or cut length raises ValueError.
    """
    at, names, version = 0, ARC_FIELDS[1].split(), 1
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        own = ARC_FIELDS[2].split() if line.startswith("filedesc://") and len(line.split(" ")) == 10 else names
        values = line.rsplit(" ", len(own) - 1)
        if end < 0 or len(values) != len(own) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}")
        size = int(values[-1])
        body = data[end + 1 : end + 1 + size]
        if len(body) != size:
            raise ValueError(f"record at byte {at} is cut")
        at = end + 1 + size
        found = dict(zip(own, values, strict=True))
        if line.startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            names = ARC_FIELDS[version].split()
            continue
        yield ArcRecord(found.pop("URL"), found.pop("IP-address"), found.pop("Archive-date"), found.pop("Content-type"), body, version, found)


def record_id(page_id: int | None, salt: str) -> str:
    """A UUID of version 8 that holds the page's number in 64 of its bits and a digest of ``salt`` in the other 58; of version 5 without a number."""
    if page_id is None:
        return str(uuid.uuid5(uuid.NAMESPACE_URL, salt))
    bits = ((page_id & (2**64 - 1)) << 58) | int.from_bytes(hashlib.sha1(salt.encode()).digest()[:8]) >> 6
    top, mid, low = bits >> 74, (bits >> 62) & 0xFFF, bits & (2**62 - 1)
    return str(uuid.UUID(int=(top << 80) | (8 << 76) | (mid << 64) | (2 << 62) | low))


def page_of(identifier: str) -> int | None:
    """The page's number in a record id, or None."""
    x = uuid.UUID(identifier.removeprefix("<urn:uuid:").removesuffix(">"))
    if x.version != 8:
        return None
    bits = ((x.int >> 80) << 74) | (((x.int >> 64) & 0xFFF) << 62) | (x.int & (2**62 - 1))
    page_id = bits >> 58
    return page_id - 2**64 if page_id >= 2**63 else page_id


def http_response(payload: bytes, mime: str, page_id: int | None) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


def _http_fields(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    pairs = (line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, v in pairs}, payload


def warc_record(arc: ArcRecord, refers_to: int | None = None) -> bytes:
    """The WARC record equivalent to an ARC record: a response, or a revisit of the page ``refers_to``, which keeps the HTTP header only."""
    fields, payload = _http_fields(arc.body)
    page_id = int(fields["x-page-id"]) if "x-page-id" in fields else None
    date = f"{arc.date[:4]}-{arc.date[4:6]}-{arc.date[6:8]}T{arc.date[8:10]}:{arc.date[10:12]}:{arc.date[12:14]}Z"
    block = arc.body if refers_to is None else arc.body[: len(arc.body) - len(payload)]
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{record_id(page_id, arc.url + arc.date)}>",
        "WARC-Date": date,
        "WARC-Target-URI": arc.url,
        "WARC-IP-Address": arc.ip,
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:uuid:{record_id(refers_to, '')}>"}
    return WARC_VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def unzipped(data: bytes, step: int = 1 << 16, most: int = 1 << 20) -> Iterator[bytes]:
    """The content of gzip members one after another, or the data itself, in pieces of ``most`` bytes at most.

    A member without its end raises ValueError, wherever it is cut.
    """
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), most):
            yield data[at : at + most]
        return
    view, at = memoryview(data), 0
    while at < len(view):
        z, held = zlib.decompressobj(31), b""
        while not z.eof:
            if not held and at >= len(view):
                raise ValueError("a gzip member is cut")
            if not held:
                held = view[at : at + step]
                at += len(held)
            out = z.decompress(held, most)
            held = z.unconsumed_tail
            if out:
                yield out
        at -= len(z.unused_data)


def parse_warc(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by declared lengths, with no more than a record and a chunk in memory.

    Time is proportional to the bytes: what was read is passed by an offset and dropped once a chunk.
    """
    held, at, looked = bytearray(), 0, 0
    for chunk in chunks:
        del held[:at]
        looked, at = max(0, looked - at), 0
        held += chunk
        while True:
            while at < len(held) and held[at] in b"\r\n":
                at += 1
            end = held.find(b"\r\n\r\n", max(at, looked))
            if end < 0:
                looked = max(at, len(held) - 3)
                break
            if not held.startswith(b"WARC/", at):
                raise ValueError("no WARC record where one should begin")
            pairs = (line.split(b":", 1) for line in held[at:end].split(b"\r\n")[1:])
            head = {k.strip().lower().decode(): v.strip().decode() for k, v in pairs}
            size = int(head["content-length"])
            looked = end
            if len(held) < end + 4 + size:
                break
            yield head, bytes(held[end + 4 : end + 4 + size])
            at = looked = end + 4 + size
    if held[at:].strip(b"\r\n"):
        raise ValueError("the last record is cut")


def _recorded(version: int, date: str):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        get = lambda k: batch.column(batch.schema.get_field_index(k)).to_pylist()
        out, size = [[]], 0
        for page_id, url, first, payload in zip(get("page_id"), get("url"), get("first"), column_bytes(batch, "html"), strict=True):
            arc = arc_file([ArcRecord(url or "-", "0.0.0.0", date, "text/html", http_response(payload, "text/html", page_id))], version, date)
            for record in parse_arc(arc):
                record = warc_record(record, first if first is not None and first != page_id else None)
                if size and size + len(record) > PACK_BYTES:
                    out.append([])
                    size = 0
                out[-1].append(record)
                size += len(record)
        # the writer of text files ends each row with the last of the closing bytes of its last record
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(x)[:-1] for x in out if x], pa.binary()).cast(pa.string())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str, version: int = 1, least_bytes: int = 0, date: str = "20260101000000") -> None:
    """Gzipped WARC files of ``pages(page_id, url, html)`` under ``path``, each page by way of an ARC record of the given version.

    Of pages with equal payloads of ``least_bytes`` or more the one with the smallest id is a response and the others revisit it. Equal
    payloads are found by digest, counted before the shuffle. Files are bounded by bytes (``PACK_BYTES``, ``FILE_PACKS``); executors write them by
    Spark's writer. Repeated rows are records of their own, null ids and urls are written as such, other columns are ignored; an empty table
    gives a folder without records.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("d", F.sha1(F.col("html").cast("binary")))
    firsts = pages.where(F.octet_length("html") >= least_bytes).groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("d", "first")
    records = mapped(pages.join(firsts, "d", "left").select("page_id", "url", "html", "first"), _recorded(version, date), "value string")
    records.write.option("maxRecordsPerFile", FILE_PACKS).option("compression", "gzip").text(path)


def _reread(batches):
    for batch in batches:
        for content in batch.column(0):
            out = []
            for head, block in parse_warc(unzipped(content.as_buffer().to_pybytes())):
                fields, payload = _http_fields(block)
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and base32_sha1(payload) != digest:
                    raise ValueError(f"the payload of {head['warc-record-id']} doesn't match its digest")
                refers = page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None
                out.append((page_of(head["warc-record-id"]), len(payload) if kind == "response" else int(fields["content-length"]), digest, kind, refers, head["warc-target-uri"]))
                if len(out) == 5000:
                    yield _batch(out)
                    out = []
            yield _batch(out)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the WARC files under ``path``; the payloads of responses are held against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_reread, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def archived(pages: DataFrame, version: int = 1, least_bytes: int = 0, scope: Scope | None = None) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, which ``scope`` deletes, and read them back.

    Null html is an empty payload; a null url is written as ``-``; a page without an id keeps none, and revisits the smallest id of an equal
    payload if there is one. Repeated rows with the smallest id are responses all. An empty table gives no rows. Other columns are ignored.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, version, least_bytes)
    out = read_archives(pages.sparkSession, path)
    if scope is not None:
        scope.adopt(out, path)
    return out
