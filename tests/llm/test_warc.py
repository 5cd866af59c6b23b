"""WARC round trip and transaction assembly."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tierscope.llm import warc

PAYLOADS = [None, "", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "\r\n\r\n\r\n\r\n", "é" * 50_000, "same", "same",
            "ends\r\n", "same", "\n", ""]


@pytest.mark.parametrize("least", [0, 1])
def test_round_trip(spark, tmp_path, least):
    rows = [(f"http://h/{i} a\r\nb" if i % 3 else None, None if i == 5 else i, p, "clash") for i, p in enumerate(PAYLOADS)]
    pages = spark.createDataFrame(rows, "url string, page_id bigint, html string, digest string").coalesce(2)
    path = str(tmp_path / "warc")
    warc.write(pages, path, least)
    t = warc.transactions(warc.read(spark, path)).collect()
    assert len(t) == len(rows)
    ids = {r.record_id: r for r in t}
    seen = {}
    for r in t:
        assert len(r.requests) == 1 and len(r.metadata) == 1
        seen[r.metadata[0]["fields"].get("page-id")] = r
    for i, p in enumerate(PAYLOADS):
        r, raw = seen[None if i == 5 else str(i)], (p or "").encode()
        same = [None if j == 5 else j for j, q in enumerate(PAYLOADS) if (q or "") == (p or "")]
        kept = max((j for j in same if j is not None))
        assert r.payload_bytes == len(raw)
        assert r.digest == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if len(raw) >= least and kept != (None if i == 5 else i):
            assert r.type == "revisit" and r.payload is None
            assert ids[r.refers_to].metadata[0]["fields"]["page-id"] == str(kept)
        else:
            assert r.type == "response" and bytes(r.payload) == raw and r.refers_to is None


def test_repeated_and_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "p"), (1, "u", "p")], "page_id bigint, url string, html string")
    warc.write(pages, str(tmp_path / "a"))
    t = warc.transactions(warc.read(spark, str(tmp_path / "a")))
    assert sorted(r.type for r in t.collect()) == ["response", "revisit"]
    warc.write(pages.where("false"), str(tmp_path / "b"))
    assert warc.transactions(warc.read(spark, str(tmp_path / "b"))).count() == 0


def test_records_without_a_capture(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "p")], "page_id bigint, url string, html string")
    warc.write(pages, str(tmp_path / "a"))
    records = warc.read(spark, str(tmp_path / "a"))
    request = records.where("type = 'request'").first().record_id
    lone = records.where("type <> 'response'").withColumn(
        "concurrent_to", F.when(F.col("type") == "metadata", F.lit(request)))
    t = warc.transactions(lone).collect()
    assert {r.type for r in t} == {None} and sum(len(r.requests) for r in t) == 1


def test_broken_payload_is_an_error(spark, tmp_path):
    record = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Payload-Digest: sha1:AAAA\r\n"
              "Content-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabcd")
    spark.createDataFrame([(record,)], "value string").write.option("lineSep", warc.END).option(
        "compression", "gzip").text(str(tmp_path / "a"))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, str(tmp_path / "a")).collect()
