import gzip
import hashlib
import os

from pyspark.sql import functions as F

from sparkloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def test_round_trip(spark):
    nasty = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n" * 3
    rows = [
        (1, "http://a/", nasty, "?"), (2, None, None, None), (3, "u\r\nX: y", "é" * 2000, None), (4, "u", "é" * 2000, None), (5, "u", "WARC/1.0\r\n" + "z" * 10, None),
        (6, "u", "", None), (7, "u", "small", None), (8, "u", "small", None), (9, "u", "\r\n" * 500 + "WARC/1.0" + "\r\n" * 40, None), (10, "u", nasty * 40, None), (11, "u", "é" * 2000, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    path = warc.archive(df, "page_id", "url", "html", chunk_bytes=64)
    chunks = warc.read_chunks(spark, path).withColumn("id", F.regexp_extract("record_id", "record:([0-9]+)>", 1).cast("int"))
    got = {}
    for r in chunks.orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append(r)
    assert len(got) == len(rows)
    for i, _, html, _ in rows:
        data, parts = (html or "").encode(), got[i]
        assert [p["last"] for p in parts] == [False] * (len(parts) - 1) + [True]
        if i in (3, 4):
            assert parts[0]["record_type"] == "revisit" and parts[0]["refers_to"] == "<urn:sparkloom:record:11>"
            assert (parts[0]["payload_length"], parts[0]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
            continue
        assert {p["record_type"] for p in parts} == {"response"}
        assert b"".join(bytes(p["data"]) for p in parts) == data
        seen = b""
        for p in parts:  # the digest is carried along
            seen += bytes(p["data"])
            assert (p["n_bytes"], p["sha1"]) == (len(seen), hashlib.sha1(seen).hexdigest())
        assert parts[0]["payload_digest"] == hashlib.sha1(data).hexdigest()


def test_files_are_warc(spark):
    path = warc.archive(spark.createDataFrame([(1, "http://a/", "hello", None)], SCHEMA), "page_id", "url", "html")
    folder = path.removeprefix("file:").replace("//", "/")
    data = b"".join(gzip.open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.endswith(".gz"))
    head, _, body = data.partition(b"\r\n\r\n")
    size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split(b":")[1])
    assert data.startswith(b"WARC/1.0\r\n") and body[size:] == b"\r\n\r\n" and body[:size].endswith(b"\r\n\r\nhello")


def test_foreign_records_that_hold_the_separator(spark, tmp_path):
    inner = b"a\r\n\r\nWARC/1.0\r\nWARC-Type: x\r\n\r\nb"
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(inner), inner)
    with gzip.open(tmp_path / "x.warc.gz", "wb") as f:
        f.write(record + record.replace(b"<r>", b"<s>"))
    rows = warc.read_chunks(spark, f"file://{tmp_path}").collect()
    assert [(r["record_id"], bytes(r["data"])) for r in rows] == [("<r>", inner), ("<s>", inner)]


def test_empty_table(spark):
    path = warc.archive(spark.createDataFrame([], SCHEMA), "page_id", "url", "html")
    assert warc.read_chunks(spark, path).count() == 0


def test_oversized_foreign_record_and_one_that_breaks_off(spark, tmp_path):
    """Two files in one task: what the first leaves open takes nothing from the second; a long record comes in chunks."""
    body = (b"line of a long payload\n" * 7 + b"\r\nWARC/1.0\r\n\r\n") * 4000
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <%s>\r\nContent-Length: %d\r\n\r\n"
    with gzip.open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(head % (b"long", len(body)) + body + b"\r\n\r\n" + head % (b"cut", 500) + b"only this")
    with gzip.open(tmp_path / "b.warc.gz", "wb") as f:
        f.write(head % (b"next", 4) + b"next\r\n\r\n")
    rows = warc.read_chunks(spark, f"file://{tmp_path}").coalesce(1).collect()
    by = {}
    for r in rows:
        by.setdefault(r["record_id"], []).append(r)
    parts = by["<long>"]
    assert b"".join(bytes(p["data"]) for p in parts) == body and len(parts) >= len(body) // (warc.CHUNK + 100)
    assert max(len(p["data"]) for p in parts) <= warc.CHUNK + 100 and [p["last"] for p in parts] == [False] * (len(parts) - 1) + [True]
    assert parts[-1]["sha1"] == hashlib.sha1(body).hexdigest()
    assert [bytes(r["data"]) for r in by["<next>"]] == [b"next"] and not any(r["last"] for r in by.get("<cut>", []))


def test_repeated_identifiers_and_a_plan_too_large_to_broadcast(spark, monkeypatch):
    from sparkloom.llm import common

    long = "é" * 100_000
    rows = [(1, "u", "a", None), (1, "u", "b", None), (1, "u", "b", None), (2, "u", long, None), (3, "u", long, None), (None, "u", "x", None), (4, "u", long + "!", None)]
    for limit in (common.BROADCAST_BYTES, -1):
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        path = warc.archive(spark.createDataFrame(rows, SCHEMA).repartition(3), "page_id", "url", "html")
        got = {}
        for r in warc.read_chunks(spark, path).filter("last").collect():
            got.setdefault(int(r["record_id"].split(":")[-1].rstrip(">")), []).append((r["record_type"], r["n_bytes"], r["sha1"]))
        sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
        assert sorted(got[1]) == sorted([("response", 1, sha("a"))] + [("response", 1, sha("b"))] * 2)
        assert got[2][0][0] == "revisit" and got[3] == [("response", 200_000, sha(long))] and got[4] == [("response", 200_001, sha(long + "!"))]
        assert sorted(got) == [1, 2, 3, 4]
