"""WARC archives: writing, reading back, segment reassembly and chunked transfer framing.

Writing.  One response record for each page; a page whose payload equals that of a page with a larger id becomes a
revisit record without payload.  A response's block is an HTTP message with chunked transfer framing; a block
above segment_bytes is written as a first record and continuation records, which name their origin and number,
the last one with the total length.  Files are plain concatenations of records written by Spark's own text writer,
so that any store that Spark writes to will do.

Reading.  Files are split at record heads, so that large archives are read in parallel.  Records of one block are
grouped by the identifier of their origin, ordered by segment number and checked against the total length; archives are
read once, and of whole records only the decoded row is shuffled.  Blocks are decoded from chunked framing and payloads checked against
their digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut

VERSION = b"WARC/1.1"
HEAD = "WARC/1.1\r\n"
CHUNK_BYTES, SEGMENT_BYTES = 4096, 32_768
BROADCAST_REVISITS = 200_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, ok boolean"
#: A whole record's row, or a segment; a whole record has an origin of its own and no segment number.
PIECE = "origin string, number int, total long, header string, block binary, " + RECORD


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _at_character(data: bytes, low: int, at: int) -> int:
    """A place after low and near `at` that isn't inside a UTF-8 character; `at` itself in other data."""
    for place in (at, at - 1, at - 2, at - 3, at + 1, at + 2, at + 3):
        if place > low and (place >= len(data) or data[place] & 0xC0 != 0x80):
            return min(place, len(data))
    return at


def chunked(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """payload in chunked transfer framing; no chunk holds the text that begins a record."""
    out, at = [], 0
    while at < len(payload):
        end = _at_character(payload, at, min(len(payload), at + chunk_bytes))
        head = payload.find(VERSION, at, end + len(VERSION))
        if head >= 0:
            end = min(end, head + 4)
        out.append(b"%x\r\n%b\r\n" % (end - at, payload[at:end]))
        at = end
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; chunk extensions and trailers are dropped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its version line and without the two line ends after it."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", str(len(block)))])
    return lines.encode("utf-8") + b"\r\n" + block


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: str, segment_bytes: int) -> list[bytes]:
    """The records of one page, in order."""
    # A record id names the page before the question mark and this copy of it after that.
    name = f"<urn:page:{'none' if page_id is None else page_id}?copy={copy}>"
    kind = "response" if refers_to is None else "revisit"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("Content-Type", "application/http;msgtype=response")]
    digest = ("WARC-Payload-Digest", "sha1:" + payload_digest(payload))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = (http + f"Content-Length: {len(payload)}\r\n\r\n").encode()
        more = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        return [_record([("WARC-Type", kind), ("WARC-Record-ID", name), *common, digest, *more], block)]
    block = (http + "Transfer-Encoding: chunked\r\n\r\n").encode() + chunked(payload)
    first = [("WARC-Type", kind), ("WARC-Record-ID", name), *common, digest]
    if len(block) <= segment_bytes:
        return [_record(first, block)]
    cuts = [0]
    while cuts[-1] < len(block):
        cuts.append(_at_character(block, cuts[-1], min(len(block), cuts[-1] + segment_bytes)))
    out = []
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
        if n == 1:
            headers = [*first, ("WARC-Segment-Number", "1")]
        else:
            headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", name[:-1] + f"&segment={n}>"), *common[:2], ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(n))]
            if b == len(block):
                headers.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(headers, block[a:b]))
    return out


def _write(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row += 1
                records = page_records(page_id, url, html or b"", refers_to, f"{part}.{row}", segment_bytes)
                out += [HEAD.encode() + r for r in records]
                size += sum(map(len, records))
                if size > 8_000_000:
                    yield _strings(out)
                    out, size = [], 0
            if out:
                yield _strings(out)

    return run


def _strings(values: list[bytes]) -> pa.RecordBatch:
    """Bytes as a string column, as they are."""
    binary = pa.array(values, pa.large_binary())
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_string(), len(binary), binary.buffers()).cast(pa.string())], names=["value"])


def find_revisits(hashed: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, digest, refers_to): distinct pairs of a page and a payload of at least min_bytes that a page with a larger id has too.

    hashed has id, digest and size of each page.
    """
    usable = hashed.where((F.col("size") >= min_bytes) & F.col("id").isNotNull())
    groups = usable.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("least")).where("least < refers_to")
    # The payload of very many pages: a side that is an exchange of its own is one that adaptive execution splits.
    groups = groups.select(F.concat("digest", F.lit("")).alias("digest"), "refers_to")
    return usable.select("id", "digest").distinct().join(groups, "digest").where("id <> refers_to").select("id", "digest", "refers_to")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write pages(page_id, url, html, ...) as WARC files under path.

    Of pages with equal payloads of at least min_bytes that with the largest page_id is a response, those with other ids
    are revisits that refer to it; all others are responses.  A null html is an empty payload, a null url is about:blank,
    pages with a null page_id are responses.  Repeated rows are records of their own; a page_id that repeats with other
    payloads is treated for each payload by itself.  Other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("html"))
    revisits = cut(find_revisits(pages.select(F.col("page_id").alias("id"), F.sha1("html").alias("digest"), F.octet_length("html").alias("size")), min_bytes))
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    marked = pages.join(revisits, (F.col("page_id") == F.col("id")) & (F.sha1("html") == F.col("digest")), "left").select("page_id", "url", "html", "refers_to")
    marked.mapInArrow(_write(segment_bytes), "value string").write.option("lineSep", "\r\n\r\n").mode("errorifexists").text(path)


def parse_head(head: bytes) -> dict[str, str]:
    """Named fields by lower-case name; folded lines are joined."""
    out: dict[str, str] = {}
    for line in re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n"):
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], str, bytes]]:
    """(fields, head, block) of every record.  A block in which a record's first line occurs comes in several pieces."""
    waiting = b""
    for batch in batches:
        for piece in batch.column(0).to_pylist():
            if waiting:
                piece = waiting + HEAD.encode() + piece
            head, gap, rest = piece.partition(b"\r\n\r\n")
            if not gap:
                waiting = b""
                continue
            fields = parse_head(head)
            size = int(fields.get("content-length", "0"))
            if len(rest) < size:
                waiting = piece
                continue
            waiting = b""
            yield fields, head.decode("utf-8", "replace"), rest[:size]


def _page_of(identifier: str | None) -> int | None:
    match = re.match(r"<urn:page:(-?\d+)[?>]", identifier or "")
    return int(match[1]) if match else None


def decode_block(fields: dict[str, str], block: bytes) -> tuple[bytes | None, int]:
    """(payload, its length) of an HTTP block; the payload is None where the block is a revisit's."""
    head, _, body = block.partition(b"\r\n\r\n")
    http = parse_head(head)
    if fields.get("warc-type") == "revisit":
        return None, int(http.get("content-length", "0"))
    payload = dechunked(body) if http.get("transfer-encoding", "").lower() == "chunked" else body
    return payload, len(payload)


def _row(fields: dict[str, str], block: bytes | None) -> tuple:
    """A row of RECORD; ok is false where the block is damaged or the payload doesn't have the digest in the head."""
    kind = fields.get("warc-type")
    page, refers = _page_of(fields.get("warc-record-id")), _page_of(fields.get("warc-refers-to"))
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    try:
        payload, size = decode_block(fields, block) if block is not None else (b"", 0)
    except ValueError:
        payload, size, block = b"", 0, None
    digest = stated if payload is None else payload_digest(payload)
    return page, kind, refers, size, digest, block is not None and digest == stated


_TYPES = {"page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "ok": pa.bool_()}
_SEGMENT = {"origin": pa.string(), "number": pa.int32(), "total": pa.int64(), "header": pa.string(), "block": pa.binary()}


def _rows(rows: list[tuple], types: dict[str, pa.DataType] = _TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PIECE: whole records are decoded here and leave only their row, segments leave their block."""
    task, rows, size = TaskContext.get().partitionId(), [], 0
    types, whole, none = _SEGMENT | _TYPES, 0, (None,) * len(_TYPES)
    for fields, head, block in _pieces(batches):
        if "warc-segment-number" in fields:
            number, total = int(fields["warc-segment-number"]), fields.get("warc-segment-total-length")
            origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
            rows.append((origin, number, int(total) if total else None, head if number == 1 else None, block, *none))
            size += len(block)
        elif fields.get("warc-type") in ("response", "revisit"):
            whole += 1
            rows.append((f"{task}/{whole}", None, None, None, None, *_row(fields, block)))
        if len(rows) == 2000 or size > 8_000_000:
            yield _rows(rows, types)
            rows, size = [], 0
    if rows:
        yield _rows(rows, types)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RECORD from rows of PIECE sorted by origin and number; one segmented record is held at a time."""
    now, head, blocks, numbers, total = None, None, [], [], None
    rows: list[tuple] = []

    def done() -> None:
        block = b"".join(blocks)
        complete = numbers == list(range(1, len(numbers) + 1)) and total == len(block)
        fields = parse_head((head or "").encode())
        rows.append(_row(fields, block if complete and head is not None else None))

    for batch in batches:
        for origin, number, all_, header, block, *whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number is None:
                rows.append(tuple(whole))
                continue
            if origin != now:
                if now is not None:
                    done()
                now, head, blocks, numbers, total = origin, None, [], [], None
            head = header or head
            total = all_ if all_ is not None else total
            blocks.append(block)
            numbers.append(number)
        if len(rows) >= 500:
            yield _rows(rows)
            rows.clear()
    if now is not None:
        done()
    if rows:
        yield _rows(rows)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row of RECORD for each response or revisit record of the WARC files under path, in any order.

    Continuations are joined to their origins.  ok is false for records that are damaged: a segment is missing or doubled,
    the total length or chunk framing is wrong, or the payload's digest isn't the one in the head.  Archives of others
    whose payloads hold the first line of a record must have files below the split size.
    """
    pieces = spark.read.option("lineSep", HEAD).text(path).where("value <> ''").select(F.col("value").cast("binary").alias("value"))
    parsed = pieces.mapInArrow(_parse, PIECE)
    return parsed.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(_reassemble, RECORD)
