import base64
import gzip
import hashlib
import io

import pytest

from tesserae.llm.warc import Reader, WarcError, member, parse, read_archives, through_archives, write_archives, write_record


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        first[b] = min(first.get(b, i), i)
    return sorted((i, len((h or "").encode()), sha((h or "").encode()), "response" if first[(h or "").encode()] == i else "revisit", None if first[(h or "").encode()] == i else first[(h or "").encode()]) for i, _, h in rows)


def test_pages_through_archives(spark, monkeypatch, tmp_path):
    import tesserae.llm.warc as w

    monkeypatch.setattr(w, "ARCHIVE_BYTES", 4000)
    rows = [(i, f"https://h/{i}", None if i % 11 == 0 else ("é<p>" * (i % 7) if i % 3 else f"page {i} " * 40)) for i in range(120, 0, -1)] + [(500, "u\r\nX: y%0A", "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = through_archives(df).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows)
    assert {r.page_id: r.url for r in got} == {i: u for i, u, _ in rows}
    write_archives(df, f"file://{tmp_path}/a")
    whole = {r.page_id: bytes(r.payload) for r in read_archives(spark, f"file://{tmp_path}/a").collect() if r.record_type == "response"}
    assert len(list((tmp_path / "a").glob("*.warc.gz"))) > 3
    assert all(whole[i] == (h or "").encode() for i, _, h in rows if i in whole)
    small = {r.page_id: r.record_type for r in through_archives(df, least=50).collect()}
    assert small[11] == small[22] == "response"


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, None, "a", 1), (1, None, "a", 1), (2, "u", "a", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in through_archives(df).collect())
    assert got == [(0, "response", None), (1, "response", None), (1, "revisit", 1), (2, "revisit", 1)]
    assert through_archives(df.limit(0)).count() == 0


def test_members_stand_alone_and_damage_is_found():
    a, b = write_record(1, "u", b"hello" * 100_000, None, True), write_record(2, None, b"hello" * 100_000, 1, False)
    pages = [parse(*r) for r in Reader(io.BytesIO(a + b))]
    assert [p["record_type"] for p in pages] == ["response", "revisit"] and pages[1]["payload_bytes"] == 500_000
    assert gzip.decompress(b).startswith(b"WARC/1.1\r\nWARC-Type: revisit")
    raw = gzip.decompress(a)
    for bad in (a[:-20], a + b"rubbish", gzip.compress(raw.replace(b"hellohello", b"helloHello", 1)), gzip.compress(raw[:-4]), gzip.compress(raw + b"x"), gzip.compress(b"nothing"), member([("WARC-Type", "response")], b"")[:-1]):
        with pytest.raises(WarcError):
            list(Reader(io.BytesIO(bad)))
