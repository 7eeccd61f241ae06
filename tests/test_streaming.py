import pytest
from pyspark.sql import functions as F

from actaspark.streaming import feeds


def test_idempotent_sink(spark, tmp_path):
    sink = feeds.IdempotentSink(str(tmp_path / "t"), ["e", "u"], "id")
    b0 = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x")], "id long, e string, u string")
    b1 = spark.createDataFrame([(4, "a", "x"), (5, "c", "x")], b0.schema)
    for batch, n in ((b0, 0), (b1, 1), (b1, 1), (b0, 0)):
        sink(batch, n)
    assert {r["id"] for r in sink.table(spark, b0.schema).collect()} == {1, 3, 5}


def test_stream_windows_equal_batch(spark, tmp_path):
    e = spark.createDataFrame([(i, i % 3, float(i)) for i in range(200)], "i long, g long, value double").select(F.timestamp_seconds(F.col("i") * 60).alias("ts"), "g", "value")
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = feeds.tumbling(s, "ts", "g").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(spark.table("w")) == key(feeds.tumbling(e, "ts", "g"))


def test_until_known_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    d = lambda xs: spark.createDataFrame([("f", i, k) for i, k in xs], "fonte string, posto long, noto boolean").coalesce(1)
    d([(0, False), (1, True)]).write.parquet(path)
    s = spark.readStream.schema("fonte string, posto long, noto boolean").parquet(path)
    q = feeds.until_known(s, "fonte", 3).writeStream.outputMode("append").format("memory").queryName("k").start()
    q.processAllAvailable()
    d([(2, True), (3, True), (4, False)]).write.mode("append").parquet(path)
    q.processAllAvailable()
    q.stop()
    assert sorted(r["posto"] for r in spark.table("k").collect()) == [0, 1, 2, 3]
