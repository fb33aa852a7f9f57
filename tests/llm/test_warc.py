import base64
import hashlib
import random

import pytest

from tidemark.llm.common import scratch
from tidemark.llm.warc import chunked, decode, dechunk, op5_warc, parse, read_archives, records, write_archives

PAGES = "page_id bigint, url string, html string, sha string, first string"


@pytest.fixture(scope="module")
def case():
    r = random.Random(9)
    pages = [(i, f"http://x/{i}", "é<p>" * r.choice([0, 1, 50, 3000]) + str(i % 7), "clash", None) for i in range(60)]
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\n0\r\n\r\n\r\n\r\n\x00"
    return pages + [(100, None, None, "x", "y"), (101, "a\r\nb", "", "x", "y"), (102, "u", tricky, "x", "y"), (103, "u", tricky, "x", "y"), (None, "u", "no id", "x", "y"), (104, "u", "no id", "x", "y"), (5, pages[5][1], pages[5][2], "x", "y"), (105, "u", "long " * 400_000, "x", "y")]


def want(pages, least=0):
    first = {}
    for p, _, h, *_ in pages:
        h = (h or "").encode()
        if len(h) >= least and p is not None:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, _, h, *_ in pages:
        h = (h or "").encode()
        f = first.get(h, p)
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        out.append((str(p) if p is not None else None, len(h), digest, "response" if p == f else "revisit", None if p == f else str(f)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "segment"), [(0, 64 << 10), (100, 700)])
def test_round_trip(spark, case, least, segment):
    path = scratch(spark, "warc")
    write_archives(spark.createDataFrame(case, PAGES), path, least, segment, records_per_file=50)
    rows = read_archives(spark, path).collect()
    assert [r.error for r in rows if r.error] == []
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == want(case, least)
    texts = {(str(p) if p is not None else None, (h or "").encode()) for p, _, h, *_ in case}
    assert all((r.page_id, bytes(r.payload)) in texts for r in rows if r.record_type == "response")
    assert all(r.payload is None for r in rows if r.record_type == "revisit")


def archive(*parts):
    return b"".join(p + b"\r\n\r\n" for p in parts)


def test_faults_are_reported(spark, tmp_path):
    parts = list(records("1", "u", b"abc" * 1000, None, segment_bytes=500))
    (tmp_path / "whole.warc").write_bytes(archive(*reversed(parts)))
    (tmp_path / "missing.warc").write_bytes(archive(*(p for i, p in enumerate(records("2", "u", b"abc" * 1000, None, segment_bytes=500)) if i != 2)))
    (tmp_path / "short.warc").write_bytes(archive(*records("3", "u", b"abc", None))[:-20])
    (tmp_path / "wrong.warc").write_bytes(archive(*records("4", "u", b"abc", None)).replace(b"3\r\nabc", b"3\r\nabd"))
    rows = {r.page_id: r for r in read_archives(spark, f"file://{tmp_path}").collect()}
    assert rows["1"].error is None and bytes(rows["1"].payload) == b"abc" * 1000
    assert "segment" in rows["2"].error and "digest" in rows["4"].error
    assert "cut short" in rows[None].error


def test_framing():
    for payload in (b"", b"x", b"abc" * 10_000):
        assert dechunk(chunked(payload, 1000)) == payload
    assert decode(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"
    with pytest.raises(ValueError):
        dechunk(b"5\r\nab\r\n0\r\n\r\n")
    assert [b for _, b in parse(archive(*records("1", None, b"q", None)))][0].endswith(b"1\r\nq\r\n0\r\n\r\n")


def test_empty_and_query(spark, sf):
    path = scratch(spark, "warc")
    write_archives(spark.createDataFrame([], PAGES), path)
    assert read_archives(spark, path).count() == 0
    assert op5_warc(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()
