"""WARC archives: segmented records, revisit records, reassembly and chunked transfer framing.

Writing: one HTTP response per page; bodies over CHUNKED_FROM bytes use chunked transfer framing;
a record block over SEGMENT_BYTES is cut into a first segment and continuation records. Of equal
payloads one page keeps its response, the others become revisit records. The archives are plain
.warc text written by Spark itself: a record's two closing line breaks are the writer's line
separator, so files land wherever Spark can write.

Reading: every archive is parsed by the records' Content-Length, segments are grouped by origin
identifier (a group is one record), put in order of segment number, checked against the total
length, and the body is taken out of its chunked framing.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, prepare, shared_path

CRLF = b"\r\n"
CHUNKED_FROM = 2048
CHUNK = 1024
SEGMENT_BYTES = 16 << 10
#: A record's block has at most SEGMENT_BYTES, so a file of so many records has about 17 MB whatever its pages' sizes.
RECORDS_PER_FILE = 1000
DATE = "2024-01-01T00:00:00Z"


def b32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id, digest: str, url) -> str:
    h = hashlib.md5(f"{page_id}|{digest}|{url}".encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _chunked(payload: bytes, chunk: int) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i : i + chunk] for i in range(0, len(payload), chunk))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body: sizes in hexadecimal, extensions and trailers passed over."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(bytes(body[at:end]).split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("chunk without its end")
        out.append(body[at : at + n])
        at += n + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + lines + b"Content-Length: %d\r\n\r\n" % len(block) + block


def page_records(page_id, url, payload: bytes, first, first_url, revisit: bool, segment: int, chunked_from: int) -> list[bytes]:
    """The records of one page: a revisit, or a response with its continuations."""
    digest = b32_sha1(payload)
    uri = _uri(page_id, digest, url)
    page = "" if page_id is None else page_id
    target = "".join(ch for ch in url or "" if ch not in "\r\n")
    common = [("WARC-Record-ID", uri), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("Page-ID", page), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        extra = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _uri(first, digest, first_url)), ("Refers-To-Page-ID", first)]
        return [_record(extra + common, block)]
    frame = len(payload) >= chunked_from
    length = b"Transfer-Encoding: chunked" if frame else b"Content-Length: %d" % len(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + length + b"\r\n\r\n" + (_chunked(payload, CHUNK) if frame else payload)
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), *common], block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        h = hashlib.md5(f"{uri}|{n}".encode()).hexdigest()
        own = f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"
        total = len(block) if n == len(parts) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", uri), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part))
    return out


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, segment: int = SEGMENT_BYTES, chunked_from: int = CHUNKED_FROM) -> None:
    """Write a record for every row of pages(page_id, url, html) as .warc files at path.

    Of equal payloads of at least least_bytes bytes the row with the smallest page_id is the
    response. Null html is an empty payload; rows whose page_id equals the smallest, or of a
    group that has only null ids, are all responses; null ids sort last. Further columns aren't read.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"), F.length(payload).alias("n"))
    same = pages.select("page_id", "url", F.sha1(payload).alias("sha1"), F.length(payload).alias("n")).where(F.col("n") >= least_bytes)
    same = same.groupBy("sha1").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("copies"))
    same = same.where("copies > 1").select("sha1", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))
    same = materialise(same, "warc-equal")  # small tables are broadcast by their true size, others shuffle
    rows = rows.join(same, "sha1", "left") if same.take(1) else rows.withColumns({"first": F.lit(None).cast("long"), "first_url": F.lit(None).cast("string")})
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("n") >= least_bytes)
    rows = rows.select("page_id", "url", "payload", "first", "first_url", revisit.alias("revisit"))

    def records(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, body, first, first_url, again = (c[k].as_py() for c in batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array(page_records(page_id, url, body or b"", first, first_url, again, segment, chunked_from), pa.binary())], names=["record"])

    lines = rows.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: bytes):
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError("no WARC record here")
        end = data.index(b"\r\n\r\n", at)
        headers = {}
        for line in bytes(data[at:end]).split(CRLF)[1:]:
            k, _, v = line.decode().partition(":")
            headers[k.lower()] = v.strip()
        n = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + n]
        if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("record without its end")
        at = end + 8 + n


RECORDS = "kind string, uri string, page_id long, url string, digest string, refers_to long, segment int, total long, block binary"


def _parse(batches):
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for h, block in parse(content.as_py()):
                rows.append({"kind": h["warc-type"], "uri": h.get("warc-segment-origin-id", h["warc-record-id"]), "page_id": int(h["page-id"]) if h.get("page-id") else None, "url": h.get("warc-target-uri"), "digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": int(h["refers-to-page-id"]) if h.get("refers-to-page-id") else None, "segment": int(h["warc-segment-number"]) if "warc-segment-number" in h else None, "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, "block": bytes(block)})
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[i : i + 256], schema=ARROW)


ARROW = pa.schema([("kind", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
OUT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, status string, payload binary"
OUT_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("status", pa.string()), ("payload", pa.binary())])


def _open(row: dict) -> dict:
    """A whole HTTP block -> the page's payload and how its checks went."""
    head, _, body = row["block"].partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(CRLF)[1:]:
        k, _, v = line.decode("latin1").partition(":")
        fields[k.strip().lower()] = v.strip()
    out = {"page_id": row["page_id"], "url": row["url"], "refers_to": row["refers_to"], "record_type": row["kind"], "status": row["status"]}
    if row["kind"] == "revisit":
        return out | {"payload_bytes": int(fields["content-length"]), "payload_digest": row["digest"], "payload": None}
    try:
        payload = dechunk(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
    except ValueError:
        payload, out["status"] = b"", "bad chunks"
    digest = b32_sha1(payload)
    if out["status"] == "ok" and digest != row["digest"]:
        out["status"] = "bad digest"
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload}


def _open_whole(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield pa.RecordBatch.from_pylist([_open(r | {"status": "ok"}) for r in batch.slice(i, 256).to_pylist()], schema=OUT_ARROW)


def _reassemble(batches):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            by: dict[int, dict] = {}
            copies = 0
            for p in row["parts"]:
                by.setdefault(p["segment"], p)
                copies += p["segment"] == 1
            first = by.get(1)
            if first is None:
                out.append({"page_id": None, "url": None, "payload_bytes": None, "payload_digest": None, "record_type": "continuation", "refers_to": None, "status": "no first segment", "payload": None})
                continue
            total = next((p["total"] for p in by.values() if p["total"] is not None), None)
            block = b"".join(by[n]["block"] for n in sorted(by))
            good = len(by) == max(by) and total == len(block)
            out += [_open({"kind": first["kind"], "page_id": first["page_id"], "url": first["url"], "digest": first["digest"], "refers_to": None, "block": block, "status": "ok" if good else "bad total length"})] * copies
        yield pa.RecordBatch.from_pylist(out, schema=OUT_ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every page of the archives at path, with its whole payload and the status of its checks.

    status: ok, bad total length (segments missing or cut), bad chunks, bad digest, or no first
    segment. Archives without records give no rows.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    records = files.mapInArrow(_parse, RECORDS)
    whole = records.where("segment is null").mapInArrow(_open_whole, OUT)
    part = F.struct("segment", "kind", "page_id", "url", "digest", "total", "block")
    cut = records.where("segment is not null").groupBy("uri").agg(F.collect_list(part).alias("parts")).select("parts")
    return whole.unionByName(cut.mapInArrow(_reassemble, OUT))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages(page_id, url, html, ...) as archives to the shared folder and read them back.

    One row per row of pages. Null html is an empty payload, a null url an empty one; null and
    repeated ids and equal rows each keep their own record; very long pages are cut into segments
    and put together again; an empty table gives an empty result; further columns aren't read.
    """
    spark = prepare(pages.sparkSession)
    path = shared_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(spark, path)
