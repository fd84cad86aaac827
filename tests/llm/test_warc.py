import base64
import gzip
import hashlib
import random

import pytest

from isobath.llm import warc as W

SF = "/root/testdata/sf0.001"


def response(record_id, payload, chunk=7):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + W.chunked(payload, chunk)
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Payload-Digest", digest)], block


def stored(path, files):
    path.mkdir()
    for i, records in enumerate(files):
        (path / f"{i}.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))
    return str(path)


@pytest.mark.parametrize("n", [0, 1, 6, 7, 8, 100])
def test_chunked_framing_round_trip(n):
    data = bytes(range(256))[:n]
    assert W.dechunked(W.chunked(data, 7)) == data


def test_broken_chunked_framing():
    whole = W.chunked(b"hello world, hello", 5)
    assert all(W.dechunked(whole[:k]) is None for k in range(len(whole)))
    assert W.dechunked(b"zz\r\nab\r\n0\r\n\r\n") is None and W.dechunked(b"5;x=y\r\nhello\r\n0\r\nTrailer: 1\r\n\r\n") == b"hello"
    assert W.dechunked(b"-5\r\nhello\r\n0\r\n\r\n") is None


def test_segments_are_joined_across_files(spark, tmp_path):
    rng = random.Random(2)
    payloads = {f"urn:x:{i}": rng.randbytes(rng.choice([0, 5, 50, 500])) + b"\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\n" for i in range(40)}
    files = [[] for _ in range(5)]
    for name, payload in payloads.items():
        for part in W.segments(*(x := response(name, payload))[:1], name, x[1], 64):
            rng.choice(files).append(part)
    for own in files:
        rng.shuffle(own)
    rows = W.payloads(W.reassembled(W.read_records(spark, stored(tmp_path / "a", files)))).collect()
    assert {r["record_id"]: r["payload"] for r in rows} == payloads
    assert {r["problem"] for r in rows} == {None} and len(rows) == len(payloads)
    assert all(r["payload_digest"] == hashlib.sha1(payloads[r["record_id"]]).hexdigest() for r in rows)


def test_problems_are_told(spark, tmp_path):
    fields, block = response("urn:x:1", b"a" * 300)
    first, second, *others = W.segments(fields, "urn:x:1", block, 100)
    lost = list(W.segments(*response("urn:x:2", b"b" * 300)[:1], "urn:x:2", response("urn:x:2", b"b" * 300)[1], 100))
    short = list(W.segments(*response("urn:x:3", b"c" * 300)[:1], "urn:x:3", response("urn:x:3", b"c" * 300)[1], 100))
    files = [
        [first, second, second, *others],  # a segment twice
        lost[:1] + lost[2:],
        [*short[:-1], short[-1].replace(b"Total-Length: ", b"Total-Length: 1")],
        [W.record(response("urn:x:4", b"d")[0], response("urn:x:4", b"e")[1])],
        [W.record(response("urn:x:5", b"d")[0], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\nab")],
        [lost[1].replace(b"urn:x:2", b"urn:x:6")],
    ]
    path = stored(tmp_path / "a", files)
    (tmp_path / "a" / "cut.warc").write_bytes(W.record(*response("urn:x:7", b"f" * 50))[:-20])
    got = {r["record_id"]: r["problem"] for r in W.payloads(W.reassembled(W.read_records(spark, path))).collect()}
    assert got.pop("urn:x:6:2") == "segments"
    assert got == {"urn:x:1": None, "urn:x:2": "segments", "urn:x:3": "length", "urn:x:4": "digest", "urn:x:5": "framing", "urn:x:7": "truncated"}


def test_pages_round_trip(spark):
    long = "é<html>\r\n\n" * 9000
    rows = [(1, "u", None, 0), (2, "u\r\nX: y", "", 1), (3, None, "x" * 999, 2), (4, "u", "x" * 999, 3), (5, "u", "y" * 1000, 4), (9, "u", "y" * 1000, 5), (7, "u", "y" * 1000, 6), (8, "u", long, 7), (6, "u", long, 7), (8, "u", long, 8), (None, "u", "z", 9)]
    got = W.archived(spark.createDataFrame(rows, "page_id long, url string, html string, row long").coalesce(1)).collect()
    assert len(got) == len(rows) and {r["problem"] for r in got} == {None}
    seen = sorted((r["record_id"].split(":")[2], r["record_type"], r["payload_bytes"], (r["fields"].get("warc-refers-to") or "::-").split(":")[2]) for r in got)
    n = len(long.encode())
    assert seen == sorted([("1", "response", 0, "-"), ("2", "response", 0, "-"), ("3", "response", 999, "-"), ("4", "response", 999, "-"), ("5", "revisit", 1000, "9"), ("9", "response", 1000, "-"), ("7", "revisit", 1000, "9"), ("8", "revisit", n, "8"), ("8", "response", n, "-"), ("6", "revisit", n, "8"), ("", "response", 1, "-")])
    assert {bytes(r["payload"]) for r in got if r["record_id"].split(":")[2] == "8" and r["payload"]} == {long.encode()}


def test_no_pages(spark):
    assert W.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_query_against_brute_force(spark):
    from isobath.llm.common import table
    from isobath.llm.queries import op1_warc

    pages = {r["page_id"]: (r["html"] or "").encode() for r in table(spark, SF, "pages").collect()}
    last = {}
    for i, p in pages.items():
        last[p] = max(i, last.get(p, i))
    expected = {(i, len(p), hashlib.sha1(p).hexdigest(), *(("revisit", last[p]) if len(p) >= 1000 and last[p] != i else ("response", None))) for i, p in pages.items()}
    assert {tuple(r) for r in op1_warc(spark, SF).collect()} == expected


def test_plain_files_that_spark_splits(spark, tmp_path):
    rng = random.Random(4)
    payloads = {f"urn:x:{i}": b"\n".join(rng.randbytes(rng.randint(0, 300)) for _ in range(20)) for i in range(60)}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.warc").write_bytes(b"".join(W.record(*response(n, p, 100)) + b"\r\n\r\n" for n, p in payloads.items()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9001")
    try:
        records = W.read_records(spark, str(tmp_path / "a"))
        rows = W.payloads(W.reassembled(records)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["record_id"]: bytes(r["payload"]) for r in rows} == payloads and {r["problem"] for r in rows} == {None}
