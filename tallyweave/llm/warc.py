"""WARC archives of web pages: writing with segmented records, and reading with reassembly.

Writing: pages of equal payloads are one response, the others revisits that refer to it.  A
response's block is an HTTP message in chunked transfer coding; a block longer than the
segment size is cut into a first record and continuation records.  Archives are text files
of whole records, closed by the two line ends that the format asks for, compressed as one
gzip stream each, and written by Spark to wherever Spark can write.

Reading: archives are parsed by their length headers; records are grouped by their origin
record, ordered by segment number, and put together; the total length, the chunk framing
and the payload digest are verified.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.shared import hub_join, place, stored, tidy

CLOSE = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"  # pages have no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_text(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer coding with chunks of ``size`` bytes."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body (extensions and trailers are allowed), or None if its framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            while True:  # trailers
                end = body.find(b"\r\n", at)
                if end < 0:
                    return None
                if end == at:
                    return b"".join(parts) if end + 2 == len(body) else None
                at = end + 2
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def clean_uri(url: str | None) -> str:
    """A header value: line ends and other control characters can't stand in it."""
    return "".join(c for c in url or "" if c >= " " and c != "\x7f")


def page_records(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, segment: int, chunk: int) -> list[bytes]:
    """The records of one page without their closing line ends."""
    digest = digest_text(payload)
    name = f"<urn:page:{'' if page_id is None else page_id}:{digest}>"
    common = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", clean_uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    kind = ("Content-Type", "application/http; msgtype=response")
    if revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", f"<urn:page:{'' if first is None else first}:{digest}>"), ("WARC-Profile", PROFILE), kind], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    if len(block) <= segment:
        return [record([("WARC-Type", "response"), *common, kind], block)]
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    out = [record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1), kind], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}:{digest}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), *last]
        out.append(record(own, part))
    return out


def write_archives(pages: DataFrame, path: str, segment: int = 16_384, chunk: int = 4_096, least: int = 0, archive_bytes: int = 16 << 20) -> int:
    """Writes a record (or several segments) for each row of page_id, url, html to archives under ``path``.

    Of rows with equal payloads of ``least`` bytes or more the largest page_id is the response, the
    others refer to it (rows that repeat the response's page_id are responses too, and a null
    page_id is below all others).  A null html counts as empty.  Other columns are ignored.
    Archives have about ``archive_bytes`` of payload each, however many pages there are: a
    task writes that much on average and begins a new file after as many records as make it up,
    none of which is above ``segment`` bytes.  Which pages refer to which is decided over ids and
    20-byte digests; payloads are dealt out by page, so that one which many pages share is no shuffle key.
    Returns how many tasks wrote.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    size = own.agg(F.sum(F.octet_length("payload")), F.count(F.lit(1)), F.sum(F.ceil((F.octet_length("payload") + 1) / segment))).first()
    keys = own.where(F.octet_length("payload") >= least).select("page", "page_id", "sha1")
    firsts = keys.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    decided = hub_join(keys, firsts, ["sha1"], size[1]).select("page", "sha1", "first", (~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit")).distinct()
    n = max(1, -(-(size[0] or 0) // archive_bytes))
    joined = own.repartition(n, "page", "sha1").join(decided.hint("shuffle_hash"), ["page", "sha1"], "left").select("page_id", "url", "payload", "first", F.coalesce("revisit", F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    out += page_records(*row, segment, chunk)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = joined.coalesce(n).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    average = max(1, (size[0] or 0) // max(1, size[2] or 1))
    records.write.option("lineSep", CLOSE).option("compression", "gzip").option("maxRecordsPerFile", max(1, 2 * archive_bytes // average)).text(path)
    return n


def plain(archive: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an archive, plain or gzip (one stream or a member for each record), some at a time."""
    if archive[:2] != b"\x1f\x8b":
        yield from (archive[at : at + step] for at in range(0, len(archive), step))
        return
    rest = archive
    while rest:
        stream = zlib.decompressobj(31)
        while not stream.eof:
            out = stream.decompress(rest, step)
            rest = stream.unconsumed_tail
            if not out and not rest and not stream.eof:
                raise ValueError("the archive's last gzip member isn't whole")
            yield out
        rest = stream.unused_data


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, which is inflated as far as the record goes."""
    pieces, held, at = plain(archive), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        del held[:at]
        at = 0
        while at == len(held):
            if not more():
                return
        looked = 0
        while (end := held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(held) - 3)
            if not more():
                break
        if end < 0 or not held.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        at = end + 4 + int(headers["content-length"])
        while len(held) < at + 4 and more():
            pass
        if held[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record {headers.get('warc-record-id')} isn't closed")
        yield headers, bytes(held[end + 4 : at])
        at += 4


FIELDS = "origin string, segment long, total long, kind string, uri string, digest string, refers string, payload_bytes long, payload_digest string, complete boolean, block binary"


def judged(kind: str, digest: str, block: bytes) -> tuple[int | None, str, bool, bytes | None]:
    """Bytes and digest of a whole message's payload, whether it fits the record's digest, and the payload (a revisit states its size only)."""
    payload, stated = http_payload(block)
    digest = (digest or "").removeprefix("sha1:")
    if kind == "revisit":
        return stated, digest, stated is not None, None
    own = digest_text(payload) if payload is not None else digest
    return (len(payload) if payload is not None else None), own, payload is not None and own == digest, payload


def read_records(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row for each record of the archives under ``path``: origin is the record's own id or, for a continuation, that of its first segment.

    Records that aren't segments are judged at once; without ``blocks`` only segments keep their block, which they need to be put together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse(content.as_py()):
                    number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
                    whole = number is None
                    size, digest, fine = judged(h.get("warc-type"), h.get("warc-payload-digest"), block)[:3] if whole else (None, None, None)
                    rows.append((h.get("warc-segment-origin-id", h.get("warc-record-id")), number and int(number), total and int(total), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to"), size, digest, fine, block if blocks or not whole else None))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, FIELDS)


def http_payload(block: bytes) -> tuple[bytes | None, int | None]:
    """The body of an HTTP message with its transfer coding undone (None if broken), and the length its header states."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None, None
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    stated = int(headers[b"content-length"]) if headers.get(b"content-length", b"").isdigit() else None
    return (unchunked(body) if b"chunked" in headers.get(b"transfer-encoding", b"").lower() else body), stated


def assemble(records: DataFrame) -> DataFrame:
    """One row for each captured page: origin, uri, kind, payload (null for revisits), payload_bytes, payload_digest, refers, complete.

    Segments are grouped by origin; a group holds one page's segments, each once.  Records that
    aren't segments are their own group and not shuffled.  complete says that the
    segments are numbered without a gap, have the total length that the last one states, are well
    framed and fit the payload digest.  A page that was written more than once comes as often.
    Continuations without a first segment give one row with complete false.
    """
    rest = [c for c in records.columns if c not in ("origin", "segment")]
    whole = records.where("segment is null").select("origin", F.array(F.struct("segment", *rest, F.lit(1).cast("long").alias("copies"))).alias("records"))
    # A page that was written often has its segments in one row each, with their number.
    segments = records.where("segment is not null").groupBy("origin", "segment").agg(F.min(F.struct(*rest)).alias("r"), F.count(F.lit(1)).alias("copies"))
    grouped = whole.union(segments.groupBy("origin").agg(F.collect_list(F.struct("segment", *(F.col(f"r.{c}") for c in rest), "copies")).alias("records")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        names = ["origin", "uri", "kind", "payload", "payload_bytes", "payload_digest", "refers", "complete"]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), []
                for origin, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    heads = [r for r in own if r["kind"] != "continuation"]
                    later = {r["segment"]: r for r in own if r["kind"] == "continuation"}
                    for head in heads:
                        block, fine = head["block"], True
                        if head["segment"] is not None:
                            numbers = range(2, len(later) + 2)
                            fine = all(n in later for n in numbers)
                            block = b"".join([block, *(later[n]["block"] for n in sorted(later))])
                            fine = fine and bool(later) and later[max(later)]["total"] == len(block)
                        if block is None:  # judged when it was read
                            rows.append((origin, head["uri"], head["kind"], None, head["payload_bytes"], head["payload_digest"], head["refers"], head["complete"]))
                            continue
                        size, digest, fits, payload = judged(head["kind"], head["digest"], block)
                        rows += [(origin, head["uri"], head["kind"], payload, size, digest, head["refers"], fine and fits)] * head["copies"]
                    if not heads:
                        rows.append((origin, None, "continuation", None, None, None, None, False))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return grouped.mapInArrow(run, "origin string, uri string, kind string, payload binary, payload_bytes long, payload_digest string, refers string, complete boolean")


def page_of(name: Column) -> Column:
    """The page_id in a record name of ``page_records`` (null where that page had none)."""
    return F.regexp_extract(name, "^<urn:page:(-?[0-9]*):", 1).try_cast("long")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to archives in the shared folder, reads them back and deletes them: page_id, payload_bytes, payload_digest, record_type, refers_to, complete."""
    spark = pages.sparkSession
    with tidy(spark):
        path = place(spark, "warc")
        n = write_archives(pages, path, **options)
        read = assemble(read_records(spark, path, blocks=False)).coalesce(max(8, n))
        return stored(read.select(page_of(F.col("origin")).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page_of(F.col("refers")).alias("refers_to"), "complete"), "pages", outlive=True)
