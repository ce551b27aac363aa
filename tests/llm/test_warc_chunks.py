import hashlib
import io

import pytest
from oracle import connection, same
from pyspark.sql import functions as F

from tabulon.llm import warc_chunks as w


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "encode(coalesce(html, ''), 'UTF-8') AS payload", "1 AS record_id", "2 AS chunk_no")


ODD = [(1, "http://a", "x" * 300_000), (1, "http://a", "x" * 300_000), (2, None, "x" * 300_000), (3, "b", None), (4, "c", "é" * 300), (5, "d\r\ne", "é" * 300), (None, "z", "q" * 200), (-7, "n", "short"), (8, "n", "short")]


def test_query_equals_its_oracle(spark, sf_dir):
    same(w.op4_warc_chunks(spark, sf_dir), connection(sf_dir), w.ORACLE)


@pytest.mark.parametrize("sent", [w.SENT_ROLES, 0])
def test_odd_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(w, "SENT_ROLES", sent)
    chunks = w.to_chunks(pages(spark, ODD), chunk_bytes=65_536, archives=1)
    rows = w.read_chunks(chunks).orderBy("record_id").collect()
    assert [r["record_id"] for r in rows] == [None, -7, 1, 1, 2, 3, 4, 5, 8] and all(r["intact"] for r in rows)
    by = {r["record_id"]: r for r in rows}
    assert by[2]["refers_to"] == 1 and by[5]["refers_to"] == 4 and by[8]["record_type"] == "response"
    assert by[2]["payload_bytes"] == 300_000 and by[3]["payload_digest"] == hashlib.sha256(b"").hexdigest()
    assert by[None]["record_type"] == "response" and by[None]["payload_bytes"] == 200
    assert by[5]["target_uri"] == "d%0A%0Ae" and by[2]["target_uri"] == "urn:page:2"
    assert chunks.groupBy("record_id", "row_no").count().agg({"count": "max"}).first()[0] == 5


def test_empty(spark):
    assert w.read_chunks(w.to_chunks(pages(spark, ODD).limit(0))).collect() == []


def test_export_is_a_warc_file(spark):
    chunks = w.to_chunks(pages(spark, ODD[2:]), chunk_bytes=65_536, archives=1)
    out = io.BytesIO()
    assert w.export_archive(chunks, 0, out) == len(out.getvalue())
    assert out.getvalue().startswith(b"WARC/1.1\r\nWARC-Type: ")
    for step in (700, 65_536):
        out.seek(0)
        rows = list(w.parse_file(out, step))
        assert len(rows) == 7 and all(r[-1] for r in rows)


def test_damage_is_found(spark):
    chunks = w.to_chunks(pages(spark, [(1, "u", "abc" * 100)]))
    bad = chunks.withColumn("data", F.encode(F.replace(F.decode("data", "UTF-8"), F.lit("abcabc"), F.lit("abcabd")), "UTF-8"))
    assert not w.read_chunks(bad).first()["intact"]


def test_large_group_of_copies(spark):
    rows = spark.range(6000).selectExpr("id AS page_id", "'u' AS url", "encode(if(id < 5000, repeat('same ', 30), repeat(string(id), 40)), 'UTF-8') AS payload")
    told = w.with_roles(rows).groupBy("record_type").agg(F.max("refers_to"), F.count("page_id")).collect()
    assert sorted((r[0], r[1], r[2]) for r in told) == [("response", None, 1001), ("revisit", 0, 4999)]


def test_pages_without_an_id(spark):
    """They revisit the smallest id of their payload; without one all are responses."""
    rows = [(None, "u", "a" * 150), (9, "u", "a" * 150), (4, "u", "a" * 150), (None, "u", "b" * 150), (None, "u", "b" * 150)]
    for sent in (w.SENT_ROLES, 0):
        with pytest.MonkeyPatch.context() as p:
            p.setattr(w, "SENT_ROLES", sent)
            told = w.read_chunks(w.to_chunks(pages(spark, rows)))
            got = sorted(((r["record_id"], r["record_type"], r["refers_to"], r["intact"]) for r in told.collect()), key=repr)
        assert got == sorted([(4, "response", None, True), (9, "revisit", 4, True), (None, "revisit", 4, True), (None, "response", None, True), (None, "response", None, True)], key=repr)


def test_large_ids_come_back(spark):
    rows = [((1 << 62) + 1, "u", "a" * 150), (-(1 << 62) - 1, "u", "c"), (None, "u", "d")]
    assert {r["record_id"] for r in w.read_chunks(w.to_chunks(pages(spark, rows))).collect()} == {r[0] for r in rows}


def test_archives_grow_with_the_payloads(spark, monkeypatch):
    monkeypatch.setattr(w, "ARCHIVE_BYTES", 10_000)
    rows = [(i, "u", f"{i:04d}" * 250) for i in range(100)]
    assert w.to_chunks(pages(spark, rows)).select("archive").distinct().count() == 11


def test_a_long_payload_is_never_held():
    """A record of 200 MB is parsed a chunk at a time, from a stream and from rows."""
    import tracemalloc

    size, part = 200 << 20, b"z" * w.CHUNK_BYTES
    sha = hashlib.sha256()
    for _ in range(size // len(part)):
        sha.update(part)
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d" % size + w.END
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:00000000-0000-4000-0000-000000000007>\r\nWARC-Payload-Digest: sha256:" + sha.hexdigest().encode() + b"\r\nContent-Length: %d" % (size + len(http)) + w.END + http

    class Stream:
        left = [head, *[part] * (size // len(part)), w.END][::-1]

        def read(self, _):
            return self.left.pop() if self.left else b""

    reader = w.Reader()
    tracemalloc.start()
    reader.feed(head + part, hashlib.sha256(part).hexdigest())
    for _ in range(size // len(part) - 1):
        reader.feed(part, None)
    reader.feed(w.END, None)
    (row,) = w.parse_file(Stream())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for r in (reader.row(), row):
        assert r[0] == 7 and r[4] == size and r[5] == sha.hexdigest() and r[-1]
    assert peak < 4 << 20
