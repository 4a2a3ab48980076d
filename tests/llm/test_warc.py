"""WARC archives read back by their chain, whatever payloads hold and wherever files are split."""

import base64
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string, size int, page string, payload string, original int"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666:X>\r\nContent-Length: 7\r\n\r\nGET /\r\n\r\n\r\n"


def rows():
    rng = np.random.default_rng(1)
    out = [
        (1, "http://a", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, "<p>one</p>"), (4, "http://c", None), (5, "http://d", ""), (6, "x\r\ny", "é中文"),
        (7, "http://e", FAKE * 3 + "tail"), (8, "http://f", "WARC/1.1\r\n" * 40), (9, "http://g", "ends with WARC/1.1\r\n"), (10, "http://h", "\r\n\r\n" + FAKE + "\r\n\r\n" * 5),
        (None, "http://i", "<p>null id</p>"), (None, "http://j", "<p>one</p>"), (12, "http://k", "long " * 30_000 + FAKE), (12, "http://k", "long " * 30_000 + FAKE),
        (13, "http://l", FAKE * 3 + "tail"), (14, "http://m", "HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n"),
        # A fake record that ends where a true one begins.
        (15, "http://n", "WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nok"),
    ]
    out += [(100 + i, f"http://s/{i}", " ".join(rng.choice(["WARC/1.1\r\n", "\r\n\r\n", "Content-Length: 5", "text", FAKE], rng.integers(0, 30)))) for i in range(60)]
    # A third of all rows have one payload.
    out += [(500 + i, f"http://hot/{i}", "<html>hot</html>") for i in range(40)]
    return [(*r, "d", 1, "p", "q", 2) for r in out]


def expected(table, least=0):
    """(page, bytes, digest, type, refers to) of each row."""
    groups = {}
    for page, _, html, *_ in table:
        groups.setdefault(html or "", []).append(page)
    out = []
    for page, _, html, *_ in table:
        payload = (html or "").encode()
        top = max(groups[html or ""], key=lambda p: (p is not None, p))
        revisit = len(payload) >= least and page != top
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.fixture
def splits(spark):
    """Sets the size of file splits for one test."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(n) for n in names]
    yield lambda size: [spark.conf.set(n, size) for n in names]
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def result(records):
    return sorted((tuple(r) for r in records.select(
        warc.page_of(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to"))).collect()), key=str)


@pytest.mark.parametrize("size, least", [("128m", 0), ("997", 0), ("4096", 11)])
def test_round_trip(spark, tmp_path, splits, size, least):
    table = rows()
    warc.write_archive(spark.createDataFrame(table, SCHEMA).repartition(3), f"{tmp_path}/w", least)
    splits(size)
    records = warc.read_archive(spark, f"{tmp_path}/w").cache()
    assert result(records) == expected(table, least)
    assert records.where("NOT intact").count() == 0
    got = {(r["page"], bytes(r["payload"])) for r in records.where("record_type = 'response'").select(warc.page_of(F.col("record_id")).alias("page"), "payload").collect()}
    kept = {(e[0], e[2]) for e in expected(table, least) if e[3] == "response"}
    assert got == {(r[0], (r[2] or "").encode()) for r in table if (r[0], base64.b32encode(hashlib.sha1((r[2] or "").encode()).digest()).decode()) in kept}
    assert {r["target_uri"] for r in records.collect()} >= {None, "x%0D%0Ay", "http://a"}
    records.unpersist()


def test_offsets_lead_to_records(spark, tmp_path, splits):
    warc.write_archive(spark.createDataFrame(rows(), SCHEMA).coalesce(1), f"{tmp_path}/w")
    splits("1500")
    found = warc.read_archive(spark, f"{tmp_path}/w").select("file", "offset", "record_id").collect()
    assert len({(r["file"], r["offset"]) for r in found}) == len(found) == len(rows())
    for r in found:
        with open(r["file"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            head = f.read(400).decode("utf-8", "replace")
        assert head.startswith("WARC/1.1\r\nWARC-Type: ") and f"WARC-Record-ID: {r['record_id']}\r\n" in head


def test_other_archives(spark, tmp_path, splits):
    """Binary payloads, records without HTTP, a broken chain, a cut last record, a wrong digest, files that begin otherwise."""
    folder = tmp_path / "own"
    os.makedirs(folder)

    def record(kind, block, extra=b"", length=None):
        n = len(block) if length is None else length
        return b"WARC/1.1\r\nwarc-type:  " + kind + b"\r\nContent-Length: %d\r\n" % n + extra + b"\r\n" + block + b"\r\n\r\n"

    body = bytes(range(256)) * 9 + FAKE.encode()
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    name = b"WARC-Record-ID: <urn:page:%d:>\r\n"
    (folder / "good").write_bytes(record(b"warcinfo", b"about", name % 1) + record(b"response", http + body, name % 2) + record(b"response", http + b"z", name % 3 + b"WARC-Payload-Digest: sha1:WRONG\r\n"))
    (folder / "broken").write_bytes(record(b"response", http + b"a", name % 4) + b"junk" + record(b"response", http + b"b", name % 5))
    (folder / "cut").write_bytes(record(b"response", http + b"c", name % 6) + record(b"response", http + b"dd", name % 7, 10_000))
    (folder / "late").write_bytes(b" " + record(b"response", http + b"e", name % 8))
    (folder / "empty").write_bytes(b"")
    for size in ("128m", "301"):
        splits(size)
        found = {r["page"]: r for r in warc.read_archive(spark, str(folder)).withColumn("page", warc.page_of(F.col("record_id"))).collect()}
        assert set(found) == {1, 2, 3, 4, 6, 7}
        assert bytes(found[2]["payload"]) == body and found[2]["payload_bytes"] == len(body)
        assert found[2]["intact"] is None and found[3]["intact"] is False and found[7]["intact"] is False
        assert found[1]["record_type"] == "warcinfo" and found[1]["payload_bytes"] == 0


def test_pointers_over_many_splits(spark):
    """A chain that enters every split, among candidates that lead nowhere or into each other."""
    chain = [("f", k // 3, k, 10 + 100 * k, 10 + 100 * (k + 1), 10 + 100 * 3 * (k // 3 + 1)) for k in range(99)]
    false = [("f", k // 3, 1000 + k, 50 + 100 * k, 50 + 100 * (k + 1), 50 + 100 * 3 * (k // 3 + 1)) for k in range(99)]
    rows_ = spark.createDataFrame(chain + false, "file string, split long, at long, place long, goes long, leaves long")
    reached = {r["place"] for r in warc._reached(rows_).collect()}
    assert reached == {10 + 300 * k for k in range(33)}


def test_empty_table_and_query(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.op11_warc_chain(spark, f"{tmp_path}/none").count() == 0
    table = [r for r in rows() if r[0] is not None]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{tmp_path}/some/pages.parquet")
    assert sorted((tuple(r) for r in queries.op11_warc_chain(spark, f"{tmp_path}/some").collect()), key=str) == expected(table)
