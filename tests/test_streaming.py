"""Streaming forms give what their batch twins give."""

from pyspark.sql import functions as F

from tidemark.streaming import live


def test_admission_and_daily_counts(spark, tmp_path):
    rows = [("a", 1, 1), ("a", 2, 2), ("a", 2, 2), ("a", 5, 4), ("b", 9, 1)]
    spark.createDataFrame(rows, "symbol string, event_id long, sequence long").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, event_id long, sequence long").json(str(tmp_path / "in"))
    q = live.admit(stream).writeStream.format("memory").queryName("admitted").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    got = sorted((x["symbol"], x["event_id"], x["state"]) for x in spark.table("admitted").collect())
    assert got == [("a", 1, "FIRST"), ("a", 2, "DUPLICATE"), ("a", 2, "VALID"), ("a", 5, "GAP"), ("b", 9, "FIRST")]
    timed = stream.withColumn("at", F.timestamp_seconds(F.col("sequence") * 86400))
    q = live.daily_counts(timed, "at").writeStream.format("memory").queryName("days").trigger(availableNow=True).outputMode("complete").start()
    q.awaitTermination(120)
    assert sum(x["n"] for x in spark.table("days").collect()) == 5
