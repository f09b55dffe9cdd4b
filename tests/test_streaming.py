from pyspark.sql import functions as F

from loomwright.streaming.profile import key_counts

SF = "/root/testdata/sf0.001"


def test_stream_and_batch_agree(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", F.length("props").alias("size"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counted = key_counts(stream, F.col("event_type"), F.col("size"), "ts")
    query = counted.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        got = sorted(map(tuple, spark.table("counted").collect()))
    finally:
        query.stop()
    assert got == sorted(map(tuple, key_counts(events, F.col("event_type"), F.col("size"), "ts").collect()))
