"""WARC archives: a writer and a sequential reader.

An archive is a run of records, each a gzip member of its own.  The writer makes
archives of bounded size in the tasks that hold the pages; Spark's text sink
writes them, one a file, to any store.  The reader takes each file in turn,
decompresses member by member with an incremental decompressor, frames a
record's block by its Content-Length and verifies block and payload digests.

Of equal payloads from a stated size on, the record of the smallest id is a
``response``; the others are ``revisit`` records that name it and carry the HTTP
head alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.llm.common import cut, raw

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NULL_ID = "null"
_CHUNK = 1 << 16


def _digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode("ascii")


def _header_value(text: str) -> str:
    """A header is one line: line ends and other controls are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" and c != "%" else f"%{ord(c):02X}" for c in text)


def _header_text(value: str) -> str:
    out, at = [], 0
    while (i := value.find("%", at)) >= 0:
        out += [value[at:i], chr(int(value[i + 1:i + 3], 16))]
        at = i + 3
    return "".join([*out, value[at:]])


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit where ``refers_to`` is given."""
    head = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = head if refers_to is not None else head + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"X-Page-Id: {_NULL_ID if page_id is None else page_id}",
        f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-Id: {refers_to}",
                  f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([packer.compress("\r\n".join(lines).encode()), packer.compress(block),
                     packer.compress(b"\r\n\r\n"), packer.flush()])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least: int = 100, archive_bytes: int = 8 << 20) -> None:
    """Write ``pages`` as WARC archives below ``path``.

    The payload is the column's UTF-8 (null: empty).  Payloads of fewer than
    ``least`` bytes are all responses.  Groups of equal payloads meet by digest as
    narrow rows only; a page goes to its record once.  Rows of one id and payload
    are equal records: each is a response where the id leads.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"),
                        F.coalesce(raw(payload_col), F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    groups = cut(keyed.filter(F.octet_length("payload") >= least).groupBy("digest")
                 .agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
                 .select("digest", "first"))
    # payloads without a copy need no partner; those with one may be many of one digest: Spark splits that side
    joined = keyed.join(groups, "digest", "left").select(
        "id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("refers_to"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            # the sink ends each file with a zero byte: take the last one of a
            # member, the high byte of its length, for it, where it is zero
            data = b"".join(held)
            data = data[:-1] if data.endswith(b"\0") else data
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, refers = (c[i].as_py() for c in batch.columns)
                held.append(record(page, url, payload, refers))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    (joined.mapInArrow(archives, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path))


class WarcError(ValueError):
    """An archive that isn't well-formed, or whose digests don't hold."""


def members(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file in turn, each decompressed a chunk at a time;
    zero bytes between them are padding."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        unpacker = zlib.decompressobj(31)
        out: list[bytes] = []
        while not unpacker.eof:
            if at >= len(data):
                raise WarcError("a member is cut off")
            chunk = view[at:at + _CHUNK]
            try:
                out.append(unpacker.decompress(chunk))
            except zlib.error as e:
                raise WarcError(str(e)) from e
            at += len(chunk) - len(unpacker.unused_data)
        yield b"".join(out)


def read_record(data: bytes) -> dict:
    """Parse and verify one record: headers by lower-case name, ``payload`` (None
    for a revisit) and ``payload_bytes`` of the full payload."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        raise WarcError("no record here")
    head = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
    head = {k.lower(): v for k, v in head.items()}
    size = int(head["content-length"])
    block = data[end + 4:end + 4 + size]
    if len(block) != size or data[end + 4 + size:] != b"\r\n\r\n":
        raise WarcError("the block isn't as long as it says")
    if _digest(block) != head["warc-block-digest"]:
        raise WarcError("block digest")
    split = block.find(b"\r\n\r\n") + 4
    length = int(next(x for x in block[:split].decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    payload = None
    if head["warc-type"] == "response":
        payload = block[split:]
        if len(payload) != length or _digest(payload) != head["warc-payload-digest"]:
            raise WarcError("payload digest")
    return {"headers": head, "payload": payload, "payload_bytes": length}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``: ``page_id``, ``url``, ``record_type``,
    ``refers_to``, ``payload_bytes``, ``payload_digest`` (hex), ``payload`` (null
    for revisits).  Raises on what isn't a sound archive; none gives no rows."""
    schema = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
              "payload_digest string, payload binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in schema.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for data in members(content.as_py()):
                    r = read_record(data)
                    h = r["headers"]
                    url, refers = h.get("warc-target-uri"), h.get("x-refers-to-page-id")
                    rows.append((
                        None if h["x-page-id"] == _NULL_ID else int(h["x-page-id"]),
                        None if url is None else _header_text(url), h["warc-type"], refers and int(refers),
                        r["payload_bytes"], base64.b32decode(h["warc-payload-digest"][7:]).hex(), r["payload"]))
                    size += len(data)
                    if size >= 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(read, schema)
