"""WARC archives: writing segmented records, and putting segments together again.

A response is an HTTP message in chunked transfer framing. A message of more than segment_bytes is written
as a first record and continuation records that name its id as their origin; the last one gives the total
length. Reading parses the archives, groups continuation records by origin, orders them by segment number,
verifies the total length and decodes the chunks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import scratch_path, shuffle_partitions, small_batches, spread_join, written

#: Bytes of a message in one record, of a chunk in the framing, and records in one archive file: a file has at most 35 MB.
#: At 8 KB the records of some 10 % of web pages, with 40 % of their bytes, lie in segments.
SEGMENT_BYTES = 8_192
CHUNK_BYTES = 4_096
FILE_RECORDS = 4_096

_CRLF = b"\r\n"
_VERSION = b"WARC/1.1"
_NAMESPACE = uuid.UUID("6f0d6bd2-5f0e-5a5e-9d9c-0a1f7c1b2e77")
_DATE = "2020-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format: a wrong length, a missing segment, bad framing."""


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[at : at + size] for at in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload inside chunked framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(_CRLF, at)
        if end < 0:
            raise WarcError("a chunk has no size line")
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError as e:
            raise WarcError(f"bad chunk size {body[at:end][:20]!r}") from e
        if size == 0:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != _CRLF:
            raise WarcError("a chunk is shorter or longer than its size line says")
        out.append(body[at : at + size])
        at += size + 2


def digest32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, part: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{part}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line breaks that end it: the writer puts those between records."""
    lines = [_VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % len(block)]
    return _CRLF.join(lines) + b"\r\n\r\n" + block


def records(page_id: int | None, url: str | None, payload: bytes, sha1: str, keeper: int | None, segment_bytes: int) -> list[bytes]:
    """The records of one page: a revisit if keeper is another page, else a response in one or more segments."""
    url = None if url is None else "".join(c for c in url if c >= " ")
    common = [("WARC-Record-ID", record_id(page_id)), ("WARC-Date", _DATE), ("WARC-Target-URI", url), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest32(sha1)}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if keeper is not None and keeper != page_id:
        more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(keeper)), ("WARC-Refers-To-Page-ID", keeper), ("Content-Type", "application/http;msgtype=response")]
        return [_record(common + more, http)]
    message = http + chunked(payload)
    parts = [message[at : at + segment_bytes] for at in range(0, len(message), segment_bytes)]
    first = [("WARC-Type", "response"), ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1 if len(parts) > 1 else None)]
    out = [_record(common + first, parts[0])]
    for n, part in enumerate(parts[1:], start=2):
        more = [("WARC-Record-ID", record_id(page_id, n)), ("WARC-Date", _DATE), ("WARC-Type", "continuation"), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", record_id(page_id)), ("WARC-Segment-Number", n)]
        out.append(_record(more + [("WARC-Segment-Total-Length", len(message) if n == len(parts) else None)], part))
    return out


def unpacked(data: bytes) -> bytes:
    """An archive's records, from a plain file or one or more gzip members."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def parse(data: bytes):
    """(fields by lower-case name, block) of every record of an archive."""
    at, end = 0, len(data)
    while at < end:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            raise WarcError(f"no end of header after byte {at}")
        lines = data[at:stop].split(_CRLF)
        if not lines[0].startswith(b"WARC/"):
            raise WarcError(f"no record at byte {at}")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        size = int(fields["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) != size or data[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise WarcError(f"the record at byte {at} is not as long as it says")
        at = stop + 8 + size
        yield fields, block


def _build(segment_bytes: int):
    def run(batches):
        for b in batches:
            out = []
            for row in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "payload", "sha1", "keeper")), strict=True):
                out += records(*row, segment_bytes)
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write every row as WARC records into files below path.

    Of rows with equal payloads of at least least_revisit_bytes, that with the largest id is the response and the
    others are revisits of it; null ids are never referred to, and if all ids are null all rows are responses. A
    null html is an empty payload, whose copies revisit each other like any others. Rows with equal id and payload
    are the same capture and get equal records. Spark's own writer puts the records into the files, so they go to
    any file system, and a lost task leaves nothing behind.
    """
    spark = pages.sparkSession
    small_batches(spark)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    rows = rows.withColumn("same", F.concat_ws("/", F.sha2("payload", 256), F.length("payload")))
    keepers = rows.where(F.length("payload") >= least_revisit_bytes).groupBy("same").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    keepers = keepers.where(F.col("n") > 1).select("same", "keeper")
    built = spread_join(rows, keepers, "same", how="left").mapInArrow(_build(segment_bytes), "record binary")
    # two line breaks end a record; a string column is written byte by byte as it is
    built.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


_PARSED = "record_id string, origin string, segment int, total long, page_id long, type string, refers_to long, digest string, block binary"


def _parsed(batches):
    for b in batches:
        for content in b.column("content"):
            rows = []
            for f, block in parse(unpacked(content.as_buffer().to_pybytes())):
                number = f.get("warc-segment-number")
                origin = f.get("warc-segment-origin-id") or (f["warc-record-id"] if number else None)
                total, page, refers = (None if x is None else int(x) for x in (f.get("warc-segment-total-length"), f.get("warc-page-id"), f.get("warc-refers-to-page-id")))
                digest = f.get("warc-payload-digest")
                rows.append((f["warc-record-id"], origin, int(number) if number else None, total, page, f["warc-type"], refers, digest and digest.removeprefix("sha1:"), block))
                if len(rows) == 1000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


_TYPES = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
_NAMES = ("record_id", "origin", "segment", "total", "page_id", "type", "refers_to", "digest", "block")


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(x, t) for n, t, x in zip(_NAMES, _TYPES, zip(*rows, strict=True), strict=True)})


def reassembled(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The message of (segment number, total length or None, block) in any order; equal numbers are copies."""
    by_number = {n: (total, block) for n, total, block in segments}
    numbers = sorted(by_number)
    if numbers != list(range(1, len(numbers) + 1)):
        raise WarcError(f"segments {numbers[:5]}... of {len(numbers)}: one is missing")
    message = b"".join(by_number[n][1] for n in numbers)
    total = by_number[numbers[-1]][0]
    if total != len(message):
        raise WarcError(f"{len(message)} bytes in segments, {total} were announced")
    return message


_PAGES = "page_id long, type string, refers_to long, digest string, payload_bytes long, payload binary"


def _finish(batches):
    """Whole messages to payloads, checked against their digests. A revisit has none."""
    for b in batches:
        payloads = []
        for kind, message, segments, digest in zip(*(b.column(n).to_pylist() for n in ("type", "block", "segments", "digest")), strict=True):
            if kind == "revisit":
                payloads.append(None)
                continue
            if segments is not None:
                message = reassembled([(s["segment"], s["total"], s["block"]) for s in segments])
            head, _, body = message.partition(b"\r\n\r\n")
            payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise WarcError("a payload does not have its digest")
            payloads.append(payload)
        sizes = pa.array([None if p is None else len(p) for p in payloads], pa.int64())
        yield pa.RecordBatch.from_pydict({n: b.column(n) for n in ("page_id", "type", "refers_to", "digest")} | {"payload_bytes": sizes, "payload": pa.array(payloads, pa.binary())})


def read_archives(spark, path: str) -> DataFrame:
    """(page_id, type, refers_to, digest, payload_bytes, payload) of every response and revisit below path; a revisit has no payload and no size.

    Only records in segments are shuffled, by origin. A missing segment, a wrong total length, bad framing or a
    digest that does not fit raises WarcError. No archive gives an empty result.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    parsed = files.mapInArrow(_parsed, _PARSED)
    whole = parsed.where(F.col("origin").isNull()).withColumn("segments", F.lit(None).cast("array<struct<segment:int,total:bigint,block:binary>>"))
    columns = ("page_id", "type", "refers_to", "digest", "block", "segments")
    grouped = parsed.where(F.col("origin").isNotNull()).repartition(shuffle_partitions(spark), "origin").groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, F.struct("page_id", "type", "digest"))).alias("head"),
        F.count(F.when(F.col("segment") == 1, 1)).alias("copies"),
        F.collect_list(F.struct("segment", "total", "block")).alias("segments"),
    )
    grouped = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
    grouped = grouped.select("head.page_id", "head.type", F.lit(None).cast("long").alias("refers_to"), "head.digest", F.lit(None).cast("binary").alias("block"), "segments")
    return whole.select(*columns).unionByName(grouped).mapInArrow(_finish, _PAGES)


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """(page_id, type, refers_to, digest, payload_bytes) of captures; a revisit takes its size from the response it refers to.

    Without their payloads the captures are written once, so archives are parsed and put together once.
    """
    narrow = written(captures.select("page_id", "type", "refers_to", "digest", "payload_bytes"), "captures")
    sizes = narrow.where(F.col("type") == "response").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("payload_bytes").alias("referred"))
    sizes = sizes.select(F.struct("refers_to", "digest").alias("of"), "referred")
    found = spread_join(narrow.withColumn("of", F.struct("refers_to", "digest")), sizes, "of", how="left")
    return found.select("page_id", "type", "refers_to", "digest", F.coalesce("payload_bytes", "referred").alias("payload_bytes"))


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Archive pages below path and read them back."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
