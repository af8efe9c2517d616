"""Web archives: a writer with deduplication by payload digest, and a reader that salvages damaged files.

Archives go to any store Spark can write to, as files of about `file_bytes` made of a gzip member for each record, so that
damage costs the records that it hits and no others. Spark's text writer puts them out, a file a row: a file's last
byte, the highest of the last member's inflated size, is the line separator NUL (a member of 16 MB or more is followed by
an empty one for that). File names end in .txt. Without compression the separator is the end of the last record. Of
records with equal payloads of at least `least_bytes`, those with the smallest page id are responses and the others
revisit them.

The reader takes all files under a path and records of all types. It checks each record (version line, mandatory headers,
length, record end, and block and payload digests of a kind it knows: md5, sha1, sha256, sha512 in hex or base32; not
the payload digest of revisits, segments and transfer-encoded payloads, which is of other bytes). After a failed check it searches for
the next gzip member that inflates, or the next version line that starts a valid record, goes on there and logs the
bytes between as a quarantined gap: a row of its own beside the records, counted in a warning by `read_archives`'s
callers through `quarantined`. `round_trip` fails if there is any, or if the number of records is not that of the pages.

Null html is an empty payload; a null url becomes a URN; a null page id is kept as null and never is a revisit's target
when others exist. Rows repeated with the smallest id are all responses. An empty table writes no record and reads none.
Extra columns are ignored. A file holds `file_bytes` and one record at most, and is what a task holds in memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stored

CRLF = "\r\n"
RECORD_END = b"\r\n\r\n"
FILE_BYTES = 16 << 20
#: Fixed value: digests that can be checked, and their bytes.
DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame, *, least_bytes: int = 100, broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """pages with payload (string), payload_bytes, payload_digest, record_type, refers_to; and the slim table of digests."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    full = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"))
    slim = stored(full.select("page_id", "payload_bytes", "payload_digest"), "warc-digests")
    groups = slim.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
    groups = stored(groups.select(F.col("payload_digest").alias("d"), "first"), "warc-groups")
    small = groups.count() <= broadcast_rows
    out = full.join(F.broadcast(groups) if small else groups, F.col("payload_digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")), slim


def record_text(date: str):
    """The record of a planned row, without the record end."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    uri = F.coalesce(F.regexp_replace("url", r"[\r\n]", " "), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"), F.lit(f"{CRLF}WARC-Record-ID: "), urn(F.col("page_id")), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), F.octet_length(block), F.lit(CRLF + CRLF),
    )
    return F.concat(head, block)


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 100, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z", compressed: bool = True) -> int:
    """Write one record per row of pages (page_id, url, html) as archives under path; the number of records."""
    planned, slim = plan_records(pages, least_bytes=least_bytes)
    end = b"\0" if compressed else RECORD_END

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            for value in b.column(0):
                record = value.as_py() + RECORD_END
                parts.append(gzip.compress(record, 6, mtime=0) if compressed else record)
                size += len(parts[-1])
                if size >= file_bytes:
                    yield whole(parts)
                    parts, size = [], 0
        if parts:
            yield whole(parts)

    def whole(parts: list[bytes]) -> pa.RecordBatch:
        if not parts[-1].endswith(end):
            parts.append(gzip.compress(b"", 6, mtime=0))
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[: -len(end)]], pa.binary())], names=["value"])

    files = planned.select(record_text(date).cast("binary").alias("value")).mapInArrow(pack, "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", end.decode()).option("maxRecordsPerFile", 1).text(path)
    return slim.count()


def agrees(digest: str, data: bytes) -> bool:
    """False if the digest is of a known kind and not that of data."""
    kind, colon, value = digest.partition(":")
    kind, value = (kind.lower().replace("-", ""), value) if colon else ("sha256", kind)
    own = hashlib.new(kind, data).digest() if kind in DIGESTS and len(value) >= DIGESTS[kind] else None
    if own is None or (len(value) != 2 * len(own) and len(value.rstrip("=")) != -(-8 * len(own) // 5)):
        return True
    return value.lower() == own.hex() or value.rstrip("=").upper() == base64.b32encode(own).decode().rstrip("=")


def parse_record(data: bytes, at: int) -> tuple[dict, int] | None:
    """The valid record that starts at `at`, and its end; None if a check fails."""
    if not re.compile(rb"WARC/1\.\d\r\n").match(data, at):
        return None
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        return None
    head = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", data[at:head_end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isdigit() or "warc-record-id" not in head or "warc-type" not in head:
        return None
    start, end = head_end + 4, head_end + 4 + int(length)
    if data[end : end + 4] != RECORD_END:
        return None
    block, kind = data[start:end], head["warc-type"].lower()
    media = head.get("content-type", "").lower()
    over_http = media.startswith("application/http") or (not media and block.startswith(b"HTTP/"))
    http, _, payload = block.partition(b"\r\n\r\n") if over_http else (b"", b"", block)
    digest = head.get("warc-payload-digest", "")
    other_bytes = kind == "revisit" or "warc-segment-number" in head or re.search(rb"(?i)\r\nTransfer-Encoding:", http)
    if not agrees(head.get("warc-block-digest", ""), block) or not (other_bytes or agrees(digest, payload)):
        return None
    full = re.search(rb"(?i)\r\nContent-Length: *(\d+)", http) if kind == "revisit" else None
    return {"head": head, "payload": payload, "payload_bytes": int(full[1]) if full else len(payload), "payload_digest": digest.removeprefix("sha256:") or None, "record_type": kind}, end + 4


def salvage_plain(data: bytes, base: int = 0, more: str = "") -> tuple[list[dict], list[tuple[int, int, str]]]:
    """The valid records of uncompressed data, and the gaps (start, end, why) between them."""
    records, gaps, at, bad = [], [], 0, -1
    while at < len(data):
        if got := parse_record(data, at):
            if bad >= 0:
                gaps.append((base + bad, base + at, "bad record" + more))
                bad = -1
            records.append(got[0])
            at = got[1]
            continue
        bad = at if bad < 0 else bad
        nxt = data.find(b"WARC/1.", at + 1)
        at = nxt if nxt >= 0 else len(data)
    if bad >= 0:
        gaps.append((base + bad, base + len(data), "bad record" + more))
    return records, gaps


def inflated(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at `at` holds up to its first damaged byte, and its end if it has no damage."""
    inflate, out, i, step = zlib.decompressobj(31), [], at, 16 << 10
    try:
        while i < len(data) and not inflate.eof:
            out.append(inflate.decompress(data[i : i + step]))
            i += len(data[i : i + step])
    except zlib.error:
        inflate = zlib.decompressobj(31)
        out = [inflate.decompress(data[at:i])]
        try:
            for k in range(i, len(data)):
                out.append(inflate.decompress(data[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(out), None
    return b"".join(out), i - len(inflate.unused_data) if inflate.eof else None


def salvage(data: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """The valid records of an archive of gzip members, plain records or both. Gaps inside a member count from its
    inflated start and say so; the others are positions in the file."""
    magic = b"\x1f\x8b\x08"
    records, gaps, at, bad = [], [], 0, -1

    def close(to: int) -> None:
        nonlocal bad
        if bad >= 0:
            gaps.append((bad, to, "no valid member or record"))
            bad = -1

    ahead = {magic: -1, b"WARC/1.": -1}  # where each next stands; looked for once, not for every gap

    def next_start() -> int:
        for what, where in ahead.items():
            if where <= at:
                found = data.find(what, at + 1)
                ahead[what] = found if found >= 0 else len(data)
        return min(ahead.values())

    while at < len(data):
        if data.startswith(magic, at):
            plain, end = inflated(data, at)
            got, inner = salvage_plain(plain, 0, f" inside the member at {at}")
            if end or got:
                close(at)
                records += got
                gaps += inner
            if end:
                at = end
                continue
        elif got_plain := parse_record(data, at):
            close(at)
            records.append(got_plain[0])
            at = got_plain[1]
            continue
        bad = at if bad < 0 else bad
        at = next_start()
    close(len(data))
    return records, gaps


def number(urn: str | None) -> int | None:
    got = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(got[1]) if got else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record or gap under path: the columns of RECORD, then file, gap_start, gap_end, gap_why (null for records)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                records, gaps = salvage(content.as_py())
                rows = [{"page_id": number(r["head"].get("warc-record-id")), "url": r["head"].get("warc-target-uri"), "payload_bytes": r["payload_bytes"], "payload_digest": r["payload_digest"], "record_type": r["record_type"], "refers_to": number(r["head"].get("warc-refers-to")), "file": name.as_py()} for r in records]
                rows += [{"file": name.as_py(), "gap_start": a, "gap_end": z, "gap_why": why} for a, z, why in gaps]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("gap_why", pa.string())])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(scan, f"{RECORD}, file string, gap_start long, gap_end long, gap_why string")


def quarantined(rows: DataFrame) -> tuple[int, int]:
    """(gaps, bytes in them; those inside a member count inflated) of what read_archives gave, logged as a warning if there
    are any. The gaps themselves are the rows with a gap_start."""
    got = rows.where("gap_start IS NOT NULL").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("gap_end") - F.col("gap_start")), F.lit(0)).alias("bytes")).first()
    if got["n"]:
        logging.getLogger(__name__).warning("%d gaps with %d bytes quarantined", got["n"], got["bytes"])
    return got["n"], got["bytes"]


def round_trip(pages: DataFrame, *, least_bytes: int = 100) -> DataFrame:
    """The columns of RECORD for each row of pages, from archives written to the shared folder and read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    written = write_archives(pages, path, least_bytes=least_bytes)
    rows = stored(read_archives(spark, path), "warc-read")
    gaps, lost = quarantined(rows)
    records = rows.where("gap_start IS NULL").select(*(c.split()[0] for c in RECORD.split(", ")))
    if gaps or records.count() != written:
        raise ValueError(f"{written} records written to {path}, {records.count()} read back, {gaps} gaps with {lost} bytes")
    return records


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS n, sha256(payload) AS digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
"""
