import gzip
import hashlib
import random

import pytest

import maskframe.llm.warc as warc
from maskframe.llm import common
from maskframe.llm.warc import Members, archives, digest_of, member, op10_warc, parse, payload_of, qualified, read_warc, record, write_warc


def pages_of(seed):
    r = random.Random(seed)
    rows = [(i, f"http://h/{i}?é\r\n\\n", "".join(chr(r.choice([97, 98, 233, 0x1F642, 10])) for _ in range(r.randint(0, 4000)))) for i in range(150)]
    same = "copy " * 40
    rows += [(200 + k, "u", same) for k in range(30)] + [(5, None, same)] + [(300 + k, "u", "short") for k in range(4)]
    rows += [(400, None, None), (None, "v", same), (401, "", ""), (200, "u", same), (402, "raw", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 9)]
    r.shuffle(rows)
    return rows


def brute(rows):
    big = 2**63 - 1
    least = {}
    for i, _, h in rows:
        least[h or ""] = min(least.get(h or "", big), big if i is None else i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and (big if i is None else i) > least[h]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", least[h] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_brute_force(spark, tmp_path, seed, monkeypatch):
    rows = pages_of(seed)
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, op10_warc(spark, str(tmp_path)).collect()), key=str) == brute(rows)


def test_round_trip_with_small_ranges(spark):
    rows = pages_of(3)
    path = common.scratch(spark, "warc")
    files = write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    assert sum(r["records"] for r in files.collect()) == len(rows)
    got = read_warc(files, path, split=1000).collect()
    number = lambda r: int(r["id"][9:]) if r["id"] != "urn:page:" else None
    assert sorted((str(number(r)), str(r["uri"])) for r in got) == sorted((str(i), str(u)) for i, u, _ in rows)
    text = {}
    for i, u, h in rows:
        text.setdefault((i, u), []).append(h or "")
    for r in got:
        if r["type"] == "response":
            assert bytes(r["payload"]).decode() in text[(number(r), r["uri"])]
    assert sorted(map(tuple, archives(spark, path).collect())) == sorted((r["file"], r["size"]) for r in files.collect())
    whole = b"".join(gzip.open(f"{path.removeprefix('file://')}/{r['file']}").read() for r in files.collect())
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == len(rows)


def test_false_magic_is_passed_over():
    import io

    one = member(record("response", 1, "u", b"\x1f\x8b\x08" * 50, "d", 150, None))
    noise = b"\x1f\x8b\x08junk" + gzip.compress(b"no record") + b"\x1f\x8b"
    data = noise + one + member(record("response", 2, "u", b"x", "d", 1, None)) + b"\x1f\x8b\x08"
    found = list(Members(io.BytesIO(data), len(data), 0, len(data), block=16))
    assert [p for p, _ in found] == [len(noise), len(noise) + len(one)] and payload_of(*parse(found[0][1])) == b"\x1f\x8b\x08" * 50
    parts = [p for a in range(0, len(data), 7) for p, _ in Members(io.BytesIO(data), len(data), a, min(a + 7, len(data)), block=5)]
    assert parts == [p for p, _ in found]


def test_records_of_other_writers(spark, tmp_path):
    """A crawl's own kinds of record: uuid ids, headers without blanks or over two lines, all types, digests of other kinds."""
    body = b"<html>\r\n\r\ncaf\xc3\xa9</html>"
    sha = hashlib.sha256(body)

    def one(kind, block, *lines):
        head = ["WARC/1.0", f"WARC-Type:{kind}", f"WARC-Record-ID:<urn:uuid:{kind}>", *lines, f"Content-Length:{len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    import base64

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    records = [
        one("warcinfo", b"software: x\r\n\r\nmore", "Content-Type: application/warc-fields"),
        one("request", b"GET / HTTP/1.0\r\nHost: h\r\n\r\n", "Content-Type:application/http; msgtype=request", "WARC-Target-URI: <http://h/>"),
        one("response", http + body, "Content-Type: application/http;msgtype=response", "WARC-Target-URI:http://h/a\\nb", "X-Long: one", "  two", "WARC-Payload-Digest: sha1:ABC"),
        one("revisit", http, "WARC-Refers-To:<urn:uuid:response>", "WARC-Payload-Digest:sha256:" + base64.b32encode(sha.digest()).decode().rstrip("=")),
        b"WARC/1.0\r\nno colon here\r\n\r\nx\r\n\r\n",
        one("metadata", b"k: v"), one("resource", body, "Content-Type: text/html"), b"WARC/1.0\nWARC-Type: conversion\nContent-Length: 2\n\nhi\n\n",
    ]
    (tmp_path / "a b%20.warc.gz").write_bytes(b"".join(map(member, records)))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    got = {r["type"]: r for r in read_warc(archives(spark, str(tmp_path)), str(tmp_path), split=100).collect()}
    assert set(got) == {"warcinfo", "request", "response", "revisit", "metadata", "resource", "conversion"}
    assert bytes(got["response"]["payload"]) == bytes(got["resource"]["payload"]) == body and got["response"]["digest"] == sha.hexdigest() == got["revisit"]["digest"]
    assert got["response"]["uri"] == "http://h/a\\nb" and got["request"]["uri"] == "http://h/" and bytes(got["request"]["payload"]) == b""
    assert got["revisit"]["payload"] is None and got["revisit"]["length"] is None and got["revisit"]["refers"] == got["response"]["id"] == "urn:uuid:response"
    assert bytes(got["warcinfo"]["payload"]).endswith(b"more") and bytes(got["conversion"]["payload"]) == b"hi" and got["conversion"]["id"] is None
    assert parse(records[2])[0]["x-long"] == "one two" and digest_of("sha1:XY") == "sha1:XY" and digest_of("sha256:AB") == "sha256:AB"


def test_places_of_archives(spark):
    assert qualified(spark, "/tmp/x y") == "file:///tmp/x y" and qualified(spark, "s3a://b/k") == "s3://b/k"
    with pytest.raises(ValueError, match="abfss"):
        qualified(spark, "abfss://c@a.net/x")


def test_long_payload_and_clashing_columns(spark):
    rows = [(1, "u", "long é " * 600_000, "f", 1), (2, "u", "long é " * 600_000, "g", 2), (3, None, None, None, None)]
    path = common.scratch(spark, "warc")
    files = write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, digest string, id int"), path)
    got = {r["id"]: r for r in read_warc(files, path, split=1 << 16).collect()}
    assert got["urn:page:2"]["type"] == "revisit" and got["urn:page:2"]["length"] == len(rows[0][2].encode()) == got["urn:page:1"]["length"]
    assert bytes(got["urn:page:1"]["payload"]).decode() == rows[0][2] and len(got) == 3


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op10_warc(spark, str(tmp_path)).count() == 0
    assert warc.REVISIT == 100
