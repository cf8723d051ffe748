import datetime as dt

from pageloom.streaming import requests as R


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_reclaim_stream(spark, tmp_path):
    rows = [(1, at(0)), (1, at(100)), (2, at(0)), (3, at(5000))]
    spark.createDataFrame(rows, "request_id long, ts timestamp").write.parquet(str(tmp_path / "in/a"))
    schema = "request_id long, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in/*"))
    query = R.reclaim_stream(stream).writeStream.format("memory").queryName("reclaimed").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    spark.createDataFrame([(4, at(20000))], schema).write.parquet(str(tmp_path / "in/b"))
    query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    got = {(r["request_id"], r["frames"]) for r in spark.table("reclaimed").collect()}
    assert {(1, 2), (2, 1)} <= got


def test_single_writer(spark, tmp_path):
    schema = "request_id long, seq long, text string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = R.single_writer(stream, str(tmp_path / "out"), "request_id", "seq", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["request_id"], r["text"]) for r in got} == {(1, "b"), (2, "c")}


def test_batched_tokens(spark):
    rows = [(1, 1, "a", at(0)), (1, 2, "b", at(0)), (1, 3, "c", at(1))]
    got = R.batched_tokens(spark.createDataFrame(rows, "request_id long, seq long, token string, ts timestamp")).orderBy("at").collect()
    assert [r["text"] for r in got] == ["ab", "c"]
