"""Archives of other writers, and what damage costs."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections import Counter
from pathlib import Path

from dialoom.llm import warc


def record(i: int, kind: str, block: bytes, *head: str) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{i}>", *head, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = "Content-Type: application/http;msgtype=response"
BODY = b"body \r\n\r\n of a page"
ANSWER = b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\n" + BODY
SHA1 = base64.b32encode(hashlib.sha1(BODY).digest()).decode()
OTHERS = [
    record(0, "warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
    record(1, "request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http;msgtype=request"),
    record(2, "response", ANSWER, HTTP, f"WARC-Payload-Digest: sha1:{SHA1}"),
    record(3, "response", ANSWER, HTTP),
    record(4, "metadata", b"no inner blank line", "Content-Type: application/warc-fields"),
    record(5, "resource", BODY, "Content-Type: text/html", f"WARC-Payload-Digest: SHA-256:{hashlib.sha256(BODY).hexdigest()}"),
    record(6, "response", ANSWER, HTTP, "WARC-Payload-Digest: blake3:abc", f"WARC-Block-Digest: sha1:{hashlib.sha1(ANSWER).hexdigest()}"),
    record(7, "response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n\r\n", HTTP, f"WARC-Payload-Digest: sha1:{SHA1}"),
    record(8, "response", b"gopher", "Content-Type: text/gopher", "X-Folded: a", " b: c"),
]


def ids(records: list[dict]) -> list[int | None]:
    return [warc.number(r["head"]["warc-record-id"]) for r in records]


def test_records_of_other_writers():
    for data in (b"".join(OTHERS), b"".join(map(gzip.compress, OTHERS))):
        got, gaps = warc.salvage(data)
        assert ids(got) == list(range(9)) and not gaps
    assert [r["payload"] for r in got[2:4]] == [BODY, BODY]
    for x, head in ((OTHERS[2], b"body "), (OTHERS[6], b"200 OK"), (OTHERS[5], b"page")):  # a digest of a known kind is checked
        assert not warc.salvage(x.replace(head, head[::-1]))[0]


def test_all_files_are_read(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(OTHERS[0]) + gzip.compress(OTHERS[2]))
    (tmp_path / "deep/y.warc").write_bytes(OTHERS[3])
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.record_type, r.payload_digest) for r in got if r.page_id) == [(2, "response", f"sha1:{SHA1}"), (3, "response", None)]
    assert len(got) == 3


def test_damage_costs_what_it_hits(spark, tmp_path):
    member = bytearray(gzip.compress(b"".join(OTHERS)))
    member[-6] ^= 1  # the checksum at the end
    got, gaps = warc.salvage(bytes(member) + gzip.compress(OTHERS[0]))
    assert ids(got) == [*range(9), 0] and gaps

    rows = [(i, f"u{i}", "".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(300))) for i in range(60)]
    rows.append((60, "long", "x" * (17 << 20)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for compressed in (True, False):
        folder = tmp_path / f"w{compressed}"
        assert warc.write_archives(df, str(folder), compressed=compressed, file_bytes=200_000) == 61
        files = sorted(folder.glob("part-*"))
        datas = [f.read_bytes() for f in files]
        assert Counter(warc.number(r["head"]["warc-record-id"]) for d in datas for r in warc.salvage(d)[0]) == Counter(range(61))
        assert all(not warc.salvage(d)[1] for d in datas) and len(files) > 2
        assert sorted(map(len, datas))[-2] < 250_000  # all but the file with the long record


def test_archives_of_our_own_lose_only_what_is_hit(spark, tmp_path):
    rows = [(i, f"http://{i}", f"<p>{i} " + hashlib.sha512(str(i).encode()).hexdigest() * 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "a"))
    (file,) = (tmp_path / "a").glob("part-*")
    whole = file.read_bytes()
    for share in (10, 50):
        at = len(whole) * share // 100
        for damaged in (whole[:at] + b"\0" * 64 + whole[at + 64 :], whole[:at] + whole[at + 100 :]):
            records, gaps = warc.salvage(damaged)
            assert 2998 <= len({warc.number(r["head"]["warc-record-id"]) for r in records}) < 3000 and gaps
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.warc.gz").write_bytes(whole[:1000] + b"\0" * 50 + whole[1050:])
    got = warc.read_archives(spark, str(tmp_path / "b"))
    gaps, size = warc.quarantined(got)
    assert gaps >= 1 and size >= 50 and got.where("gap_start IS NULL").count() >= 2998


def test_many_members_and_gaps_take_linear_time():
    import time

    one = gzip.compress(OTHERS[3])

    def took(data):
        start = time.time()
        warc.salvage(data)
        return time.time() - start

    broken = one[:30] + b"\0" * 20 + one[50:]
    few, many = one * 5000 + broken * 500, one * 50_000 + broken * 5000
    assert took(many) < 25 * took(few)
    assert len(warc.salvage(one * 50_000)[0]) == 50_000


def test_a_round_trip_with_gaps_fails(spark, monkeypatch):
    import pytest

    df = spark.createDataFrame([(i, "u", "x" * i) for i in range(20)], "page_id long, url string, html string")
    assert warc.round_trip(df).count() == 20
    write = warc.write_archives

    def damaged(pages, path, **more):
        n = write(pages, path, **more)
        for f in Path(path.removeprefix("file://")).glob("part-*"):
            data = f.read_bytes()
            f.write_bytes(data[: len(data) // 2] + data[len(data) // 2 + 9 :])
        for f in Path(path.removeprefix("file://")).glob(".*.crc"):
            f.unlink()
        return n

    monkeypatch.setattr(warc, "write_archives", damaged)
    with pytest.raises(ValueError, match="gaps"):
        warc.round_trip(df)
