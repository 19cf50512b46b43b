"""WARC archives: a deduplicating writer, and a reader that salvages what damage has left.

Every record is a gzip member of its own. The reader checks each member's CRC and each record's
version line, header, length, end and block digest. Where a check fails it looks for the next gzip
magic or version line at which a whole record passes again, gives the bytes between as a gap, and
goes on from there. In a member of several records it does so over the decompressed bytes, as far as
they come: whole records are given, and what lies between them is a gap inside the member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, new_path

#: Payloads of fewer bytes are always stored whole.
REVISIT_BYTES = 1000
#: An empty gzip member (fixed bytes), which stands between members since Spark's text writer wants a separator.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_LINE = rb"WARC/1\.[01]\r\n"
_MARK, _VERSION_LINE = re.compile(rb"\x1f\x8b\x08|" + _LINE), re.compile(_LINE)
#: Fields that a record has once.
_SINGLE = {"warc-type", "warc-record-id", "warc-date", "content-length"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2020-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, without compression. refers_to: the page whose response holds this payload, or None."""
    body = b"" if refers_to is not None else payload
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + body
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", _DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    fields += [
        ("WARC-Payload-Digest", sha1_base32(payload)),
        ("X-Payload-Length", str(len(payload))),
        ("WARC-Block-Digest", sha1_base32(block)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(ValueError):
    pass


@dataclass
class Record:
    start: int
    end: int
    fields: dict[str, str]
    block: bytes
    reason: str | None = None  #: what is wrong with the gzip member that the record was saved from


@dataclass
class Gap:
    start: int
    end: int
    reason: str
    inner: tuple[int, int] | None = None  #: where it is in the decompressed bytes of the member from start to end


def told_digest(value: str) -> tuple[str, str] | None:
    """Algorithm and lower-case hex of a labelled digest in hex or base32; None if it is neither or of an unknown algorithm."""
    name, _, told = value.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size, told = hashlib.new(name).digest_size, told.strip()
    if re.fullmatch(r"[0-9A-Fa-f]+", told) and len(told) == 2 * size:
        return name, told.lower()
    bare = told.rstrip("=").upper()
    if re.fullmatch(r"[A-Z2-7]+", bare) and len(bare) == -(-size * 8 // 5):
        return name, base64.b32decode(bare + "=" * (-len(bare) % 8)).hex()
    return None


def agrees(value: str, data: bytes) -> bool:
    """Whether data has the labelled digest; True if that can't be checked."""
    told = told_digest(value)
    return not told or hashlib.new(told[0], data).hexdigest() == told[1]


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record that begins at ``at``: header fields (lower-case names), block, end. Raises Damaged."""
    line = data.find(b"\r\n", at, at + 16)
    if line < 0 or not re.fullmatch(rb"WARC/1\.[01]", data[at:line]):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", line)
    if stop < 0:
        raise Damaged("header without end")
    fields: dict[str, str] = {}
    last = None
    for row in data[line + 2 : stop].split(b"\r\n"):
        if row[:1] in b" \t" and row and last:
            fields[last] += " " + row.strip().decode("utf-8", "replace")
            continue
        name, colon, value = row.partition(b":")
        if not colon or not re.fullmatch(rb"[!-9;-~]+", name):
            raise Damaged("malformed header line")
        last = name.decode("ascii").lower()
        if b"\r" in value or last in fields and last in _SINGLE:
            raise Damaged("header runs into another one")
        fields[last] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d+", fields.get("content-length", "")):
        raise Damaged("no content length")
    begin = stop + 4
    end = begin + int(fields["content-length"])
    if end + 4 > len(data):
        raise Damaged("block is cut off")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block has another length")
    block = data[begin:end]
    if not agrees(fields.get("warc-block-digest", ""), block):
        raise Damaged("block digest differs")
    return fields, block, end + 4


def _up_to_error(unpacker, chunk: bytes, parts: list[bytes]) -> None:
    """Appends to parts what comes before the error that is known to be in chunk."""
    n = 0
    for step in (4096, 256, 16, 1):
        while n < len(chunk):
            before = unpacker.copy()
            try:
                parts.append(unpacker.decompress(chunk[n : n + step]))
            except zlib.error:
                unpacker = before
                break
            n += step
    try:
        tail = chunk[n : n + 1]
        while got := unpacker.decompress(tail, 1):
            parts.append(got)
            tail = unpacker.unconsumed_tail
    except zlib.error:
        pass


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The decompressed bytes of the gzip member at ``at`` as far as they come, where it ends, and what is wrong with it or ''."""
    unpacker, parts, pos = zlib.decompressobj(31), [], at
    while not unpacker.eof and pos < len(data):
        chunk, before = data[pos : pos + (1 << 16)], unpacker.copy()
        try:
            parts.append(unpacker.decompress(chunk))
        except zlib.error:
            _up_to_error(before, chunk, parts)
            return b"".join(parts), pos, "gzip member fails"
        pos += len(chunk)
    return b"".join(parts), pos - len(unpacker.unused_data), "" if unpacker.eof else "gzip member is cut off"


def packed_end(data: bytes, at: int, size: int) -> int:
    """Where the bytes of the member at ``at`` end that give its first ``size`` decompressed ones."""
    unpacker, pos, left = zlib.decompressobj(31), at, size - 1
    while left > 0 and pos < len(data):
        chunk = data[pos : pos + (1 << 16)]
        left -= len(unpacker.decompress(chunk, left))
        pos += len(chunk) - len(unpacker.unconsumed_tail)
    # The last byte apart, with as little input as it needs: behind it the member may fail.
    tail = b""
    while size > 0 and not unpacker.decompress(tail, 1) and pos < len(data):
        tail = data[pos : pos + 1]
        pos += 1
    return pos


def read_at(data: bytes, at: int) -> tuple[list[Record | Gap], int, str]:
    """Records and inner gaps of the member or the plain record at ``at``, where they end, and what is wrong after that or ''.

    Raises Damaged if there is no whole record. Records of a member whose end is missing or whose
    CRC fails have a reason: their own checks passed, the member's did not.
    """
    if not data.startswith(MAGIC, at):
        fields, block, end = parse_record(data, at)
        return [Record(at, end, fields, block)], end, ""
    plain, end, why = inflate(data, at)
    found: list[Record | Gap] = []
    k, lost, reason, whole = 0, None, "", 0
    while k < len(plain):
        try:
            fields, block, after = parse_record(plain, k)
        except Damaged as e:
            if lost is None:
                lost, reason = k, str(e)
            mark = _VERSION_LINE.search(plain, k + 1)
            k = mark.start() if mark else len(plain)
            continue
        if lost is not None:
            found.append(Gap(at, end, reason, (lost, k)))
            lost = None
        found.append(Record(at, end, fields, block, why or None))
        k = whole = after
    if not whole and (why or plain):
        raise Damaged(why or reason)
    if why:
        # The rest may hold the starts of other members, so it is searched from the last whole record on.
        end = packed_end(data, at, whole)
        for x in found:
            x.end = end
    elif lost is not None:
        found.append(Gap(at, end, reason, (lost, len(plain))))
    return found, end, why


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive, in order; together they cover every byte but empty members."""
    at, lost, reason = 0, None, ""
    while at < len(data):
        try:
            found, end, why = read_at(data, at)
        except Damaged as e:
            if lost is None:
                lost, reason = at, str(e)
            mark = _MARK.search(data, at + 1)
            at = mark.start() if mark else len(data)
            continue
        if lost is not None:
            yield Gap(lost, at, reason)
            lost = None
        yield from found
        at = end
        if why:
            lost, reason = at, why
            mark = _MARK.search(data, at)
            at = mark.start() if mark else len(data)
            if at == lost:
                lost = None
    if lost is not None:
        yield Gap(lost, len(data), reason)


def write_archives(records: DataFrame, path: str) -> None:
    """records: page_id, url, payload binary, refers_to. One archive a partition; a lost task is written anew by Spark's committer."""

    def rows(batches):
        for batch in batches:
            out = [member(record(*row)) for row in zip(*(batch.column(k).to_pylist() for k in range(4)))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = records.select("page_id", "url", "payload", "refers_to").mapInArrow(rows, "member binary")
    lines = members.select(F.col("member").cast("string").alias("value"))
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


READ_SCHEMA = """kind string, file string, start long, end long, reason string, page_id long, record_type string, url string,
payload_bytes long, payload_digest string, refers_to long, payload binary, inner_start long, inner_end long"""


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record (kind 'record') and each quarantined gap (kind 'gap'); see READ_SCHEMA.

    payload_digest is the lower-case hex of the whole payload's SHA-1: computed for a response, told
    by the header for a revisit (as it stands there if it isn't a SHA-1); payload_bytes of a revisit
    is null where its header tells none. Digests are checked in hex and base32, of MD5 and SHA-1,
    -256 and -512; others are not. A response whose payload differs from the header's is damaged, and
    so a gap. A gap inside a gzip member has the member's start and end, and its place in the
    decompressed bytes as inner_start and inner_end. A record saved from a failing member has the
    member's fault as its reason. Empty files give no rows.
    """
    names = [x.split()[0] for x in READ_SCHEMA.replace("\n", " ").split(",")]

    def parsed(name: str, item: Record | Gap) -> tuple:
        if isinstance(item, Gap):
            return ("gap", name, item.start, item.end, item.reason, *[None] * 7, *(item.inner or (None, None)))
        f, kind = item.fields, item.fields.get("warc-type")
        head, _, payload = item.block.partition(b"\r\n\r\n") if f.get("content-type", "").startswith("application/http") else (b"", b"", item.block)
        told = f.get("warc-payload-digest", "")
        page, refers = (int(f[k]) if re.fullmatch(r"-?\d+", f.get(k, "")) else None for k in ("x-page-id", "x-refers-to-page-id"))
        if kind == "revisit":
            size = int(f["x-payload-length"]) if re.fullmatch(r"\d+", f.get("x-payload-length", "")) else None
            algorithm, digest = told_digest(told) or (None, None)
            digest, payload = digest if algorithm == "sha1" else told or None, None
        else:
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            if not agrees(told, payload):
                return ("gap", name, item.start, item.end, "payload digest differs", *[None] * 9)
        return ("record", name, item.start, item.end, item.reason, page, kind, f.get("warc-target-uri"), size, digest, refers, payload if payloads else None, None, None)

    schema = pa.schema([(n, {"payload": pa.binary()}.get(n, pa.int64() if n in ("start", "end", "page_id", "payload_bytes", "refers_to", "inner_start", "inner_end") else pa.string())) for n in names])

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for item in read_archive(content.as_py()):
                    rows.append(parsed(name, item))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, READ_SCHEMA)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes a record per page, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    pages: page_id, url, html; other columns are ignored. A null html is an empty payload, a null
    url leaves its field out. Of equal payloads of at least REVISIT_BYTES bytes, rows of the largest
    page_id are responses and the rest revisit it; a row of null page_id is a response. Repeated
    rows are records of their own. An empty table gives no rows.
    """
    kept = Stored(spark)
    read = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    digests = read.where(F.length("payload") >= REVISIT_BYTES).select("page_id", F.sha1("payload").alias("digest"))
    shared = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    shared = kept.put("wa_shared", shared)
    # Which pages revisit which: small rows, joined on the digest; payloads are joined on page_id only.
    revisits = kept.put("wa_revisit", digests.join(shared, "digest").where("page_id < refers_to").select("page_id", "refers_to", "digest").distinct())
    keyed = read.withColumn("digest", F.when(F.length("payload") >= REVISIT_BYTES, F.sha1("payload")))
    records = keyed.join(revisits, ["page_id", "digest"], "left")
    path = new_path(spark, "wa_archive")
    write_archives(records, path)
    back = read_archives(spark, path, payloads=False).where("kind = 'record'")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
