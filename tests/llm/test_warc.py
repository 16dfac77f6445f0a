"""Round trips through archives."""

import base64
import hashlib
import io

from pyspark.sql import functions as F

from specweave.llm import warc
from specweave.llm.common import shared_path

ROWS = [
    (3, "http://a/3", "same"), (1, "http://a/1\r\nX: y", "same"), (2, None, "same"), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://a/6", "other\r\n\r\nWARC/1.1\r\nend é"),
    (7, "http://a/7", "twin"), (7, "http://a/7", "twin"), (None, "http://a/n", "null id"), (8, "http://a/8", "x" * 2_000_000),
]


def archive(spark, rows, **more):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    path = shared_path(spark, "warc-test")
    warc.write_archives(pages, path, **more)
    return path, warc.read_archives(spark, path).collect()


def test_round_trip(spark):
    path, got = archive(spark, ROWS, records_per_file=3)
    assert len(got) == len(ROWS) and all(r["intact"] in (True, None) for r in got)
    by = {r["record_id"]: r for r in got if r["record_id"] != "7"}
    assert {i: (by[i]["record_type"], by[i]["refers_to"]) for i in "12345"} == {"1": ("response", None), "2": ("revisit", "1"), "3": ("revisit", "1"), "4": ("response", None), "5": ("revisit", "4")}
    assert [r["record_type"] for r in got if r["record_id"] == "7"] == ["response", "response"]
    assert by["6"]["payload"].decode() == ROWS[5][2] and len(by["8"]["payload"]) == 2_000_000 and by[None]["record_type"] == "response"
    assert by["3"]["payload"] is None and by["3"]["payload_bytes"] == 4
    for r in got:
        html = next((h or "") for i, _, h in ROWS if (None if i is None else str(i)) == r["record_id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
    # A payload that is shorter than the bound stays; empty tables give empty archives.
    assert {r["record_type"] for r in archive(spark, ROWS[:3], least_bytes=5)[1]} == {"response"}
    assert archive(spark, ROWS[:0])[1] == []


def test_resolve_revisits(spark):
    """Revisit records of an archive that is read in again find their response."""
    rows = [(1, "u1", "D", 4, "response", None), (9, "u9", "D", 4, "revisit", 7), (5, "u5", "E", 4, "revisit", 2), (6, "u6", "F", 4, "response", None)]
    headers = spark.createDataFrame(rows, "id long, uri string, payload_digest string, payload_bytes long, record_type string, refers_to long")
    got = {r["id"]: (r["record_type"], r["refers_to"]) for r in warc.resolve(headers).collect()}
    assert got == {1: ("response", None), 9: ("revisit", 1), 5: ("revisit", 2), 6: ("response", None)}


def test_digest(spark):
    got = spark.createDataFrame([("é",), ("",)], "v string").select(warc.digest(F.col("v"))).collect()
    assert [r[0] for r in got] == [base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in ("é", "")]


def test_broken_archives():
    for raw in (b"hello\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort"):
        try:
            list(warc.parse_archive(io.BytesIO(raw)))
        except ValueError:
            continue
        raise AssertionError(raw)


def test_many_repeated_payloads(spark, monkeypatch):
    """Beyond the bound of broadcasts, with hot digests, the verdicts are the same."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr("specweave.llm.common.BROADCAST_ROWS", 0)
    monkeypatch.setattr("specweave.llm.common.HOT_ROWS", 3)
    rows = [(i, f"http://a/{i}", None if i % 3 == 0 else f"page {i % 17}" if i % 3 == 1 else f"own {i}") for i in range(120, 0, -1)] + [(50, "http://b/50", "own 50"), (None, None, "page 1")]
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    got = archive(spark, rows)[1]
    want = [(None if i is None else str(i), "response" if i is not None and first[h or ""] == i else "revisit", None if i is not None and first[h or ""] == i else str(first[h or ""])) for i, _, h in rows]
    assert sorted(map(str, ((r["record_id"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(str, want))
