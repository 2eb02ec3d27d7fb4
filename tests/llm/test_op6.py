import hashlib
import re

import pytest

from trailmark.llm import op6

BIG = "<p>é" + "x" * 1200
ROWS = [
    (1, "http://a/1", BIG, 0), (2, "http://a/2", BIG, 0), (9, None, BIG, 0), (3, "http://a/3\r\nX: y", "small", 0), (4, "u", "small", 0), (5, "u", None, 0),
    (6, "u", "", 0), (7, "u", "z" * 999, 0), (8, "u", "z" * 999, 0), (10, "u", "é" * 500, 0), (11, "u", "é" * 500, 0), (None, "u", BIG, 0), (11, "u", "é" * 500, 0), (12, "u", "w" * 2_000_000, 0),
]


def test_records_come_back(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, sha256 int").repartition(3)
    op6.write_archive(pages, f"{tmp_path}/a")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op6.index(spark, f"{tmp_path}/a").collect()), key=str)
    want = []
    for page, _, html, _ in ROWS:
        data = (html or "").encode()
        last = max(r[0] for r in ROWS if (r[2] or "").encode() == data and r[0] is not None)
        again = page is not None and len(data) >= 1000 and page != last
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == len({(r[2] or "") for r in ROWS})
    for r in op6.read_archive(spark, f"{tmp_path}/a").collect():
        assert any(r.page_id == x[0] and bytes(r.payload) == (x[2] or "").encode() for x in ROWS)
    for r in op6.warc_bytes(op6.read_archive(spark, f"{tmp_path}/a")).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(body) - 4
        assert not re.search(rb"(?m)^X: y", head)


def test_damage_and_empty(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, x int")
    op6.write_archive(pages.limit(0), f"{tmp_path}/none")
    assert op6.index(spark, f"{tmp_path}/none").count() == 0
    op6.write_archive(pages, f"{tmp_path}/a")
    bad = spark.read.parquet(f"{tmp_path}/a/payloads").selectExpr("sha256", "concat(payload, X'00') payload")
    bad.write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="differ"):
        op6.read_archive(spark, f"{tmp_path}/b").collect()
    with pytest.raises(Exception, match="differ"):
        op6.index(spark, f"{tmp_path}/b").collect()
