"""WARC archives: a writer that cuts long records into segments, and a reader that puts them together.

Written files are gzip'd WARC/1.1. A response's block is an HTTP message whose body has chunked transfer
framing. A block longer than ``segment_bytes`` becomes a first segment and continuation records. Files are
written by Spark's text sink with the records' closing blank lines as line separator, so commits are safe
on any file system. A file is read as one value, so it has at most 2 GB as it lies there, and is decompressed as
a stream: a task holds the file's bytes and one record.

The reader takes records by their Content-Length, groups continuations by WARC-Segment-Origin-ID, orders
them by WARC-Segment-Number, verifies WARC-Segment-Total-Length and undoes the chunked framing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import materialize, small_or_shuffled


CRLF = b"\r\n"
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 1 << 16, 1 << 13, 2_000
#: Content that a revisit points to has at least so many bytes.
LEAST_REVISIT = 0
#: What the reader hands on at a time, at least.
BATCH_RECORDS, BATCH_BYTES = 256, 8 << 20
RECORD = "record_id string, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _cut(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most ``size`` bytes (at least a character) that end between UTF-8 characters."""
    at = 0
    while at < len(data):
        end = min(at + max(size, 4), len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _cut(body, size)) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked message, whose size lines may have extensions, and which may end with trailers.
    Raises ValueError if it is cut short or malformed."""
    out, at = [], 0
    while True:
        end = framed.find(CRLF, at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = framed[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("a chunk's size is not a number")
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if framed[at + n : at + n + 2] != CRLF:
            raise ValueError("a chunk is not as long as stated")
        out.append(framed[at : at + n])
        at += n + 2


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode()


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, record_id: str, segment_bytes: int) -> Iterator[bytes]:
    """A page's WARC records, each without the blank lines that end it."""
    digest = sha1_base32(payload)
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common: list[tuple[str, object]] = [("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id), ("X-Payload-Length", len(payload))]
    http = [("Content-Type", "application/http; msgtype=response")]
    if revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", refers_to)]
        yield _header([*fields, *common, *http, ("Content-Length", len(block))]) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = list(_cut(block, segment_bytes))
    number = [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
    yield _header([("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *number, *common, *http, ("Content-Length", len(parts[0]))]) + parts[0]
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        yield _header([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}-{k}>"), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", k), *total, ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Length", len(part))]) + part


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS, least_revisit: int = LEAST_REVISIT) -> None:
    """One response or revisit record per row; the payload is the html in UTF-8 (null: empty).

    Of rows with equal payloads of at least ``least_revisit`` bytes, the one with the smallest id is the
    response, and the others revisit it. Of repeated rows with that id one is the response. Ids may be null
    (larger than any other); with null ids only, one row is the response. Only digests are shuffled, and
    those that come more than once come back by a join."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1("payload")), "n": F.octet_length("payload")})
    # By digest and id first, so a payload that many pages share does not meet in one task. Rows that share the
    # response's id: one of them is chosen by its url.
    by_id = rows.groupBy("sha", "id").agg(F.count("*").alias("c"), F.min(F.xxhash64("url")).alias("u"), F.max("n").alias("n"))
    head = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "c", "u")).alias("head")
    heads = by_id.groupBy("sha").agg(head, F.sum("c").alias("copies"), F.max("n").alias("n")).where((F.col("copies") > 1) & (F.col("n") >= least_revisit))
    heads = heads.select("sha", F.col("head.id").alias("first"), F.col("head.c").alias("heads"), F.col("head.u").alias("u"))
    heads = materialize(heads, "warc-heads")
    joined = rows.join(small_or_shuffled(heads), "sha", "left")
    joined = joined.withColumn("head", F.col("id").eqNullSafe(F.col("first")) & (F.xxhash64("url") == F.col("u")))
    joined = joined.select("id", "url", "payload", "first", F.when(F.col("heads").isNull(), 0).when(~F.col("head"), 1).when(F.col("heads") == 1, 0).otherwise(2).cast("int").alias("kind"), F.base64("sha").alias("sha"))
    ready = joined.where("kind < 2").select("id", "url", "payload", "first", "kind")
    if not heads.where("heads > 1").isEmpty():
        # Kind 2: rows alike in id, url and payload, of which one is the response.
        twins = joined.where("kind = 2").groupBy("id", "url", "sha", "first").agg(F.first("payload").alias("payload"), F.count("*").alias("times"))
        twins = twins.select("id", "url", "payload", "first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("k"))
        ready = ready.unionByName(twins.select("id", "url", "payload", "first", F.when(F.col("k") == 1, 0).otherwise(1).cast("int").alias("kind")))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch, out = whole.slice(at, 128), []
                for page_id, url, payload, first, kind in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    row += 1
                    record_id = f"urn:page:{page_id}:{part}:{row}"
                    out += [r.decode() for r in records(page_id, url, payload, first, kind == 1, record_id, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    ready.mapInArrow(render, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse(data: bytes | pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a file, which may be gzip'd as a whole
    or record by record; decompressed as far as it is read. Raises ValueError at a record that is cut short."""
    packed = bytes(memoryview(data)[:2]) == b"\x1f\x8b"
    stream = gzip.GzipFile(fileobj=pa.BufferReader(data)) if packed else io.BytesIO(data)
    try:
        while line := stream.readline():
            if line == CRLF:
                continue
            at, fields = stream.tell() - len(line), {}
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record at byte {at}")
            while (line := stream.readline()) != CRLF:
                if not line.endswith(CRLF):
                    raise ValueError(f"no record at byte {at}")
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            n = int(fields["content-length"])
            block = stream.read(n)
            if len(block) < n:
                raise ValueError(f"the record at byte {at} is cut short")
            yield fields, block
    except EOFError as e:
        raise ValueError("the file is cut short") from e


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP message, without transfer framing and content coding."""
    head, _, body = block.partition(b"\r\n\r\n")
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head):
        body = unchunked(body)
    if re.search(rb"(?im)^content-encoding:\s*(x-)?gzip\b", head):
        body = gzip.decompress(body)
    elif re.search(rb"(?im)^content-encoding:\s*deflate\b", head):
        body = zlib.decompress(body)
    return body


def _finished(fields: dict[str, str], block: bytes) -> dict:
    number = lambda k: int(fields[k]) if fields.get(k, "").lstrip("-").isdigit() else None
    out = {"record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": fields.get("warc-type"), "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id")}
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": number("x-payload-length"), "payload_digest": stated, "payload": None, "error": None}
    try:
        payload = payload_of(block)
    except (ValueError, OSError, zlib.error) as e:
        return out | {"payload_bytes": None, "payload_digest": None, "payload": None, "error": str(e)}
    digest = sha1_base32(payload)
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload, "error": "the payload's digest is another" if stated and stated != digest else None}


def reassemble(segments: list[tuple[int, int | None, dict[str, str], bytes]]) -> dict:
    """One record from its segments (number, stated total length, fields, block), in any order."""
    segments = sorted(segments, key=lambda s: s[0])
    total = next((s[1] for s in reversed(segments) if s[1] is not None), None)
    block, first = b"".join(s[3] for s in segments), segments[0]
    wrong = None
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        wrong = "segments are missing or repeated"
    elif total is None or total != len(block):
        wrong = f"the segments have {len(block)} bytes, not {total}"
    if wrong:
        return _finished(first[2] | {"warc-type": "revisit"}, b"") | {"record_type": first[2].get("warc-type"), "payload_bytes": None, "payload_digest": None, "error": wrong}
    return _finished(first[2], block)


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives in a folder: record_id, record_type, page_id, refers_to, payload_bytes,
    payload_digest, payload, error (what is wrong with the record, else null). Files are read once: whole
    records are decoded there, and what was read is written to the shared folder, from which segments are shuffled
    by their origin. A folder without archives gives no records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    parts = {"origin": pa.string(), "number": pa.int64(), "total": pa.int64(), "fields": pa.string(), "block": pa.binary()}

    def table(rows: list[dict], more: dict[str, pa.DataType]) -> pa.RecordBatch:
        every = dict(zip(names, kinds, strict=True)) | more
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in every.items()], list(every))

    def shown(record: dict) -> dict:
        return record if with_payload else record | {"payload": None}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for file in batch.column(0):
                for fields, block in parse(file.as_buffer()):
                    if (number := fields.get("warc-segment-number")) is not None:
                        total = fields.get("warc-segment-total-length")
                        origin = (fields.get("warc-segment-origin-id") or fields.get("warc-record-id", "")).strip("<>")
                        yield {"origin": origin, "number": int(number), "total": int(total) if total else None, "fields": "\n".join(f"{k}:{v}" for k, v in fields.items()), "block": block}
                    elif fields.get("warc-type") in ("response", "revisit", "resource"):
                        yield shown(_finished(fields, block))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows_of(batches):
            held.append(row)
            size += len(row.get("block") or row.get("payload") or b"")
            if len(held) >= BATCH_RECORDS or size >= BATCH_BYTES:
                yield table(held, parts)
                held, size = [], 0
        yield table(held, parts)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(n), None if pd.isna(t) else int(t), dict(x.split(":", 1) for x in f.split("\n")), b) for n, t, f, b in zip(pdf["number"], pdf["total"], pdf["fields"], pdf["block"], strict=True)]
        return table([shown(reassemble(rows))], {}).to_pandas().astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    found = materialize(files.mapInArrow(read, f"{RECORD}, origin string, number long, total long, fields string, block binary"), "warc-records")
    return found.where("origin is null").select(*names).unionByName(found.where("origin is not null").select(*parts).groupBy("origin").applyInPandas(join, RECORD))
