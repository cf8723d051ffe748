import base64
import hashlib

import pytest
from compare import oracle, rows

from pageloom.llm import warc as W
from pageloom.llm.common import new_path

SCHEMA = "page_id long, url string, html string"
PAGES = [(3, "u3", "same é"), (2, "u2", "same é"), (9, "u9", "same é"), (4, None, None), (5, "a\r\nWARC-Type: x", ""), (6, "u", "WARC/1.1\r\n\r\n"), (None, "n", "no id"), (None, "m", "same é"), (7, "u", "x" * 400_000), (6, "u", "WARC/1.1\r\n\r\n")]


def frame(spark, pages=PAGES):
    from pyspark.sql import functions as F

    return spark.createDataFrame(pages, SCHEMA).withColumn("payload_key", F.lit("clash")).withColumn("header", F.lit(1))


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert rows(W.op6_warc(spark, sf)) == oracle(W.OP6_SQL, sf)


def test_edges(spark):
    path = new_path(spark, "warc")
    W.write_archive(frame(spark), path)
    got = [r.asDict() for r in W.read_archive(spark, path).collect()]
    assert len(got) == len(PAGES)
    by = {r["page_id"]: r for r in got if r["page_id"] is not None}
    assert by[2]["record_type"] == "response" and by[3]["refers_to"] == by[9]["refers_to"] == 2
    assert by[5]["record_type"] == "revisit" and by[5]["refers_to"] == 4 and by[5]["payload_bytes"] == 0
    assert all(r["record_type"] == "response" for r in got if r["page_id"] == 6)
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] is None) == [("response", None), ("revisit", 2)]
    assert by[2]["payload_digest"] == base64.b32encode(hashlib.sha1("same é".encode()).digest()).decode()
    assert by[3]["payload_bytes"] == len("same é".encode())


def test_round_trip_through_files(spark):
    path = new_path(spark, "warc")
    W.write_archive(frame(spark), path)
    whole = sorted(r["record"] for r in W.records(spark, path).collect())
    for kind in ("none", "gzip"):
        W.export_warc(spark, path, f"{path}/{kind}", kind)
        for largest in (W.LARGEST, 1):  # at once, and streamed
            kept, W.LARGEST = W.LARGEST, largest
            try:
                back = sorted(r["header"] + "\r\n" + r["payload"].decode() + "\r\n\r\n" for r in W.import_warc(spark, f"{path}/{kind}").collect())
            finally:
                W.LARGEST = kept
            assert back == whole and len(whole) == len(PAGES)


def test_payloads_of_any_bytes_and_cut_files(spark, tmp_path):
    body = bytes(range(256))
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 256\r\n\r\n" + body + b"\r\n\r\nWARC/1.0\r\ncontent-length: 0\r\n\r\n\r\n\r\n")
    got = W.import_warc(spark, str(tmp_path / "a.warc")).collect()
    assert [bytes(r["payload"]) for r in got] == [body, b""]
    (tmp_path / "b.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")
    with pytest.raises(Exception, match="cut off"):
        W.import_warc(spark, str(tmp_path / "b.warc")).collect()


def test_damage_is_found(spark):
    path = new_path(spark, "warc")
    spark.createDataFrame([("0" * 64, "not that")], "payload_key string, payload string").write.parquet(path + "/payloads")
    spark.createDataFrame([("WARC/1.1\r\n", "0" * 64)], "header string, payload_key string").write.parquet(path + "/headers")
    with pytest.raises(Exception, match="damaged payload"):
        W.read_archive(spark, path).collect()


def test_small_payloads_and_empty(spark):
    path = new_path(spark, "warc")
    W.write_archive(frame(spark), path, min_bytes=8)
    assert {r["record_type"] for r in W.read_archive(spark, path).where("payload_bytes < 8").collect()} == {"response"}
    path = new_path(spark, "warc")
    W.write_archive(frame(spark).limit(0), path)
    assert W.read_archive(spark, path).count() == 0
