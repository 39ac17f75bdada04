"""Streaming forms give what the batch ones do."""

from pyspark.sql import functions as F

from sievework.streaming.merge_stream import breaker, first_within, merge_batches, weekly_counts


def drain(writer, name):
    q = writer.queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_breaker_stream(spark, tmp_path):
    rows = [("c", i, f) for i, f in enumerate([True, True, False, True, True, True, True])] + [("d", i, False) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, at long, bad boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = breaker(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k", "at", "bad", 3)
    drain(stream.writeStream.format("memory").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1"), "stops")
    assert [tuple(r) for r in spark.table("stops").collect()] == [("c", 5)]


def test_first_within(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = first_within(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["k"], "ts")
    drain(stream.writeStream.format("memory").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2"), "firsts")
    assert sorted(r.k for r in spark.table("firsts").collect()) == ["a", "b"]


def test_merge_batches(spark, tmp_path):
    have = spark.createDataFrame([("a", "1", False, False), ("b", "1", True, False)], "k string, v string, is_human boolean, is_invalid boolean")
    kept = [have]
    apply = merge_batches(lambda: kept[-1], lambda df: kept.append(spark.createDataFrame(df.collect(), df.schema)), ["k"], ["v"], "turn")
    for epoch in range(2):
        apply(spark.createDataFrame([("a", "2", 1), ("b", "2", 1), ("c", "1", 1)], "k string, v string, turn int"), epoch)
        assert {(r.k, r.v) for r in kept[-1].collect()} == {("a", "2"), ("b", "1"), ("c", "1")}


def test_weekly_counts(spark, tmp_path):
    """Weeks run from Monday; a week is told once the watermark has passed it."""
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-07"), ("a", "2024-01-08"), ("b", "2024-01-07"), ("z", "2024-03-01")], "k string, d string").withColumn("ts", F.to_timestamp("d"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = weekly_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k", "ts").select(F.col("week.start").cast("date").cast("string").alias("week"), "k", "count")
    drain(stream.writeStream.format("memory").outputMode("append").option("checkpointLocation", f"{tmp_path}/c3"), "weeks")
    assert sorted(tuple(r) for r in spark.table("weeks").collect()) == [("2024-01-01", "a", 2), ("2024-01-01", "b", 1), ("2024-01-08", "a", 1)]
