import base64
import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zetamill.llm import warc


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"WARC/1.1", b"\r\n", b"\r\n\r\n", "é🙂".encode(), b"0", b"a" * 50, b"WARC", b"/1.1\r\n"]), max_size=30).map(b"".join), st.integers(1, 60))
def test_framing_round_trip(payload, size):
    framed = warc.chunked(payload, size)
    assert warc.dechunked(framed) == payload and warc.VERSION not in framed


def test_damaged_framing():
    framed = warc.chunked(b"x" * 100, 30)
    for bad in (framed[:50], framed.replace(b"1e", b"1f", 1), b"", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def brute(rows, least=0):
    groups = defaultdict(list)
    for i, _, html in rows:
        if i is not None:
            groups[html or ""].append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = max(groups[html or ""]) if groups[html or ""] else None
        revisit = i is not None and len(data) >= least and i != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/é b\r\nX: y", "<p>one</p>"), (2, "http://a/", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", "é🙂" * 30_000), (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3000), (7, "u", "\r\n\r\n" * 9),
    (8, "u", "é🙂" * 30_000), (9, "WARC/1.1\r\n", "0\r\n\r\n"), (10, "u", "x" * 40_000), (-4, "u", "negative"), (None, "u", "no id"), (11, "u", "twice" * 9000), (11, "u", "twice" * 9000), (12, "u", "\u0000  ﻿"),
]


@pytest.mark.parametrize("least,segment,broadcast", [(0, 32_768, 10), (0, 100, 0), (11, 1000, 10)])
def test_archive_round_trip(spark, tmp_path, monkeypatch, least, segment, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", broadcast)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as value", "2 as digest").repartition(3)
    warc.write_archive(df, str(tmp_path / "a"), least, segment)
    got = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert all(r.ok for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS, least)


def test_a_page_id_that_repeats_with_other_payloads_keeps_both(spark, tmp_path):
    rows = [(1, "u", "aaa"), (1, "u", "bbb"), (2, "u", "aaa")]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    got = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to, r.ok) for r in got) == [(1, "response", None, True), (1, "revisit", 2, True), (2, "response", None, True)]


def test_missing_segment_is_found(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "abc" * 1000)], "page_id long, url string, html string"), str(tmp_path / "a"), 0, 500)
    file = max((tmp_path / "a").glob("part-*.txt"), key=lambda f: f.stat().st_size)
    records = file.read_bytes().split(warc.HEAD.encode())
    assert len(records) > 4
    file.write_bytes(warc.HEAD.encode().join(records[:3] + records[4:]))
    for crc in (tmp_path / "a").glob(".part*.crc"):
        crc.unlink()
    (row,) = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert not row.ok and row.page_id == 1


def test_empty(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == 0
