"""WARC archives: writing with revisits, chunked framing and segments, and reading them back.

A record whose block exceeds SEGMENT_BYTES is written as segments: the first one keeps the record's headers, the rest
are continuation records that name it in WARC-Segment-Origin-ID; the last one tells the total length. Archives end at
ARCHIVE_BYTES, between segments too, so the segments of one record may lie in several archives. When read, they are
grouped by origin, put in the order of their numbers, checked against the total length, and the HTTP body is taken out
of its chunked framing.

Archives are kept as one binary value a row, each a sequence of gzip members, one a record, in a Parquet table of the
shared folder: executors cannot write plain files to a store that only Spark reaches.

Defined results: a null html is an empty payload; of repeated pages each row is written; of equal payloads the row of
the largest id is the response (of several such rows the one that comes first), null ids come last; a segment that
is missing, repeated or out of length makes ``error`` not null and the payload null, as does a payload that has not the
stated digest; an archive that is cut off or damaged gives the records before that place and one of type ``damaged`` with
the error; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.storage import cut, table

SEGMENT_BYTES = 16 << 10
ARCHIVE_BYTES = 512 << 10
CHUNK_BYTES = 4 << 10
#: Payloads below this are always written in full.
LEAST_REVISIT_BYTES = 0
#: A fixed date: archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"
_CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked framing."""
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for at in range(0, len(body), size) if (part := body[at : at + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The body of chunked framing; chunk extensions and trailers are passed over. ValueError if it is cut off."""
    parts, at = [], 0
    while True:
        end = framed.index(_CRLF, at)
        size = int(framed[at:end].split(b";")[0], 16)
        if not size:
            framed.index(_CRLF, end)  # the last chunk's end
            return b"".join(parts)
        part = framed[end + 2 : end + 2 + size]
        if len(part) < size or framed[end + 2 + size : end + 4 + size] != _CRLF:
            raise ValueError("a chunk is cut off")
        parts.append(part)
        at = end + 4 + size


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)


def http_payload(block: bytes) -> bytes:
    head, body = block.split(b"\r\n\r\n", 1)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(headers: dict[str, object], block: bytes) -> bytes:
    """One gzip member with one record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": len(block)}).items() if v is not None)
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + _CRLF + block + b"\r\n\r\n") + packer.flush()


class Headers(dict):
    """Values by name, whatever its case; of a name that comes twice the last."""

    def __init__(self, lines: list[str]):
        for name, colon, value in (line.partition(":") for line in lines):
            if colon:
                self[name.strip().lower()] = value.strip()

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)

    def number(self, name: str) -> int | None:
        """A number that may be absent."""
        value = self.get(name)
        if value is not None and not value.isascii() or value is not None and not value.isdigit():
            raise ValueError(f"{name} is no number")
        return None if value is None else int(value)


def records(archive: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of every record of an archive."""
    view = memoryview(archive)
    while len(view):
        member = zlib.decompressobj(31)
        raw = member.decompress(view)
        if not member.eof:
            raise ValueError("a record is cut off")
        view = view[len(view) - len(member.unused_data) :]
        head, end, rest = raw.partition(b"\r\n\r\n")
        headers = Headers(head.decode("utf-8", "replace").split("\r\n")[1:])
        length = headers.number("Content-Length")
        if not head.startswith(b"WARC/") or not end or length is None or len(rest) != length + 4:
            raise ValueError("the length of a record differs")
        yield headers, rest[:-4]


def segments(uid: str, headers: dict[str, object], block: bytes, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The record, or its segments."""
    name = {"WARC-Record-ID": f"<urn:page:{uid}>", "WARC-Date": DATE}
    if len(block) <= size:
        yield record(name | headers, block)
        return
    parts = [block[at : at + size] for at in range(0, len(block), size)]
    yield record(name | headers | {"WARC-Segment-Number": 1}, parts[0])
    for number, part in enumerate(parts[1:], 2):
        own = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:page:{uid}:{number}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": f"<urn:page:{uid}>"}
        total = {"WARC-Segment-Total-Length": len(block)} if number == len(parts) else {}
        yield record(own | {"WARC-Segment-Number": number} | total, part)


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT_BYTES, segment: int = SEGMENT_BYTES, archive: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record a page; returns the table (archive, data) in the shared folder."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8")))).withColumn("large", F.octet_length("html") >= least)
    newest = rows.where("large").groupBy("sha").agg(F.max("key").alias("newest"), F.max_by("url", "key").alias("newest_url")).withColumn("large", F.lit(True))
    rows = rows.join(newest, ["sha", "large"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size, number = TaskContext.get().partitionId(), 0, [], 0, 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{number:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "data"])

        for batch in batches:
            for k, link, text, refers, target in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html", "newest", "newest_url"))):
                payload = text.encode()
                uid = f"{task}.{n}"
                n += 1
                headers = {"WARC-Target-URI": link, "X-Page-ID": k, "WARC-Payload-Digest": "sha1:" + digest(payload)}
                if refers is not None and refers != k:
                    own = {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": target, "WARC-Refers-To-Date": DATE, "X-Refers-To-Page-ID": refers, "X-Payload-Bytes": len(payload)}
                    parts = segments(uid, own | headers, b"HTTP/1.1 200 OK\r\n\r\n", segment)
                else:
                    parts = segments(uid, {"WARC-Type": "response", "Content-Type": "application/http;msgtype=response"} | headers, http_block(payload), segment)
                for part in parts:
                    held.append(part)
                    size += len(part)
                    if size >= archive:
                        yield full()
                        held, size, number = [], 0, number + 1
        if held:
            yield full()

    line = lambda c: F.regexp_replace(c, "[\\r\\n]", "").alias(c)
    made = rows.select("key", line("url"), "html", "newest", line("newest_url"))
    return cut(made.mapInArrow(run, "archive string, data binary"), "warc")


_RECORD = "record_id string, key string, url string, record_type string, refers_to string, digest string, stated_bytes long, segment int, total long, block binary, payload binary, error string"


def _payload(kind: str, block: bytes | None, error: str | None, stated: str | None) -> tuple[bytes | None, str | None]:
    if kind != "response" or error is not None:
        return None, error
    try:
        payload = http_payload(block)
    except ValueError as e:
        return None, str(e)
    return (payload, None) if stated in (None, digest(payload)) else (None, "the digest differs")


def _damaged(error: Exception, record_id: str | None = None) -> tuple:
    return record_id, None, None, "damaged", None, None, None, None, None, None, None, f"{error}"


def _row(h: Headers, block: bytes) -> tuple:
    """A record as a row; a record whose headers cannot be understood is damaged, and the ones after it are read."""
    own_id = h.get("WARC-Record-ID")
    try:
        if own_id is None or h.get("WARC-Type") is None:
            raise ValueError("a record has no id" if own_id is None else "a record has no type")
        number, total, stated = map(h.number, ("WARC-Segment-Number", "WARC-Segment-Total-Length", "X-Payload-Bytes"))
        own = h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
        kind = h["WARC-Type"].lower()
        content = (block, None, None) if number else (None, *_payload(kind, block, None, own))
        return h.get("WARC-Segment-Origin-ID", own_id), h.get("X-Page-ID"), h.get("WARC-Target-URI"), kind, h.get("X-Refers-To-Page-ID"), own, stated, number, total, *content
    except ValueError as e:
        return _damaged(e, own_id)


def _rows(archive: bytes) -> Iterator[tuple]:
    """The records up to the first damage of the framing, then one of type damaged that holds the error."""
    try:
        for headers, block in records(archive):
            yield _row(headers, block)
    except (ValueError, zlib.error) as e:
        yield _damaged(e)


def read_records(archives: DataFrame) -> DataFrame:
    """One row a record or segment: segments with their block, records in one piece (segment null) with their payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _RECORD.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
        for batch in batches:
            for data in batch.column("data"):
                rows = list(_rows(data.as_py() or b""))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    return archives.select("data").mapInArrow(run, _RECORD)


def reassemble(parts: DataFrame) -> DataFrame:
    """Whole records of segments, with ``error`` where a segment is missing, repeated or of the wrong length."""
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    groups = parts.groupBy("record_id").agg(
        *[first(c) for c in ("key", "url", "record_type", "refers_to", "digest", "stated_bytes")],
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"),
    )
    block = F.expr("unhex(array_join(transform(s, x -> hex(x.block)), ''))")  # joined at once, not one after the other
    whole = groups.withColumn("block", block).withColumn(
        "error",
        F.when(F.expr("transform(s, x -> x.segment) <> sequence(1, size(s))"), "segments are missing or repeated").when(
            F.expr("total is null or total <> octet_length(block)"), "the total length differs"
        ),
    )
    return whole.drop("s", "total")


def read_archives(archives: DataFrame) -> DataFrame:
    """(key, url, record_type, refers_to, digest, stated_bytes, payload, error) of every record, reassembled."""
    names = ["key", "url", "record_type", "refers_to", "digest", "stated_bytes", "payload", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = [_payload(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("record_type", "block", "error", "digest")))]
            columns = [*(batch.column(c) for c in names[:6]), pa.array([p for p, _ in decoded], pa.binary()), pa.array([e for _, e in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    whole = read_records(archives).where("segment is null").select(names)
    parts = reassemble(read_records(archives).where("segment is not null"))
    return whole.unionByName(parts.mapInArrow(run, whole.schema))


def base32(hexadecimal: str):
    """Base32 of a column of hexadecimal digits whose number is a multiple of 5."""
    five = "conv(substr({0}, 5 * i + 1, 5), 16, 10)"
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    four = ", ".join(f"substr({letters}, cast(floor({five} / {32**k}) % 32 as int) + 1, 1)" for k in (3, 2, 1, 0))
    return F.expr(f"array_join(transform(sequence(0, cast(length({{0}}) / 5 as int) - 1), i -> concat({four})), '')".format(hexadecimal))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write and read back: key, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's digest and length are those of the response that it refers to, read from the archive.
    """
    kind = pages.schema[key].dataType.simpleString()
    found = read_archives(write_archives(pages, key, url, html))
    found = found.withColumn("sha", F.sha1("payload")).select("key", "record_type", "refers_to", F.col("digest").alias("stated_digest"), F.octet_length("payload").cast("long").alias("bytes"), base32("sha").alias("digest"))
    found = cut(found, "read")
    responses = found.where("record_type = 'response'")
    direct = responses.select("key", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to"))
    target = responses.where("key is not null").groupBy(F.col("key").alias("refers_to"), F.col("digest").alias("stated_digest")).agg(F.max("bytes").alias("payload_bytes"))
    revisits = found.where("record_type = 'revisit'").select("key", "record_type", "refers_to", "stated_digest").join(target, ["refers_to", "stated_digest"], "left")
    revisits = revisits.select("key", "payload_bytes", F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to")
    rows = direct.unionByName(revisits)
    return rows.select(F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
n AS (SELECT h, max(page_id) AS newest FROM p GROUP BY h)
SELECT p.page_id, octet_length(payload) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(p.h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) // CAST(pow(32, 3 - i % 4) AS INT)) % 32 + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN p.page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = newest THEN NULL ELSE newest END AS refers_to
FROM p JOIN n USING (h)
"""
