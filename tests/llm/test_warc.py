import glob
import gzip
import hashlib

import pytest

import folio.llm.warc as w


def test_round_trip(spark):
    big, same = "é" * 150_000 + "\r\n\r\nWARC/1.1\r\n", "same" * 400
    rows = [(1, "http://a", big), (2, None, same), (3, "u", same), (9, "u\nv", same), (4, "x", None), (5, "x", ""), (6, "x", "small"), (7, "x", "small"), (8, "y", big), (None, "z", same), (10, "q", "r" * 1000), (10, "q", "r" * 1000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    got = sorted((tuple(r) for r in w.round_trip(df).collect()), key=str)
    want = []
    for i, _, html in rows:
        p = (html or "").encode()
        top = max((j for j, _, h in rows if h == html and j is not None), default=None)
        again = len(p) >= 1000 and i != top
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=str)


def test_files_are_gzip_members_with_segments(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a" * 200_000), (2, "u", "b")], "page_id long, url string, html string").coalesce(1)
    w.write_archives(df, str(tmp_path / "out"))
    data = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(str(tmp_path / "out/part*")))
    assert data.count(b"WARC-Type: continuation") == 3 and data.count(b"WARC-Segment-Total-Length: ") == 1
    read = {r.record_id: r for r in w.read_archives(spark, str(tmp_path / "out")).collect()}
    assert read["urn:page:1"].payload == b"a" * 200_000 and read["urn:page:1"].error is None


def test_broken_segments_and_framing(spark):
    assert w.unchunked(w.chunked(b"x" * 50_000)) == b"x" * 50_000 and w.unchunked(b"3;a=b\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        w.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    block = w.HTTP + w.chunked(b"y" * 10)
    assert w._decoded(block, len(block)) == (b"y" * 10, None)
    payload, error = w._decoded(block, len(block) + 1)
    assert payload is None and "bytes" in error
    assert w.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_malformed_archives_are_read(spark, tmp_path):
    part = lambda kind, own, block, **more: w._record(kind, own, block, **more)
    block = w.HTTP + w.chunked(b"y" * 30_000)
    records = [
        part("response", "urn:page:1", block[:9000], Segment_Number=1),
        part("continuation", "urn:page:1:3", block[18_000:], Segment_Number=3, Segment_Origin_ID="<urn:page:1>", Segment_Total_Length=len(block)),  # the second one is missing
        part("continuation", "urn:page:2:2", block[9000:], Segment_Number=2, Segment_Origin_ID="<urn:page:2>", Segment_Total_Length=len(block)),
        part("continuation", "urn:page:3:2", block[9000:], Segment_Number=2, Segment_Origin_ID="<urn:page:3>", Segment_Total_Length=len(block)),
        part("response", "urn:page:3", block[:9000], Segment_Number=1),
        gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:4>\r\n\r\nno length"),
        gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: 99\r\n\r\nshort"),
        b"\x1f\x8b\x08" + b"\xff" * 20,
        part("response", "urn:page:6", w.HTTP + w.chunked(b"fine")),
        part("response", "urn:page:7", block)[:40],
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    got = {(r.kind, r.record_id): (r.payload and bytes(r.payload), r.error) for r in w.read_archives(spark, str(tmp_path)).collect()}
    assert got["response", "urn:page:1"][0] is None and "bytes" in got["response", "urn:page:1"][1]
    assert got[None, "urn:page:2"][0] is None and got["response", "urn:page:3"] == (b"y" * 30_000, None)
    assert got["unreadable", "urn:page:4"] == (None, "bad header") and got["unreadable", "urn:page:5"] == (None, "cut record")
    assert got["response", "urn:page:6"] == (b"fine", None)
    assert {e for (k, i), (_, e) in got.items() if k == "unreadable" and i is None} <= {"broken member", "cut member"}
