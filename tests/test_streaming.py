from pyspark.sql import functions as F

from quillon.streaming.windows import running_fusion, windowed_summary


def test_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 3).cast("int"))).alias("ts"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    rows.write.parquet(str(tmp_path / "in"))
    batch = windowed_summary(rows, "ts", "v", "1 hour", "10 minutes", ["g"])
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_summary(stream, "ts", "v", "1 hour", "10 minutes", ["g"]).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r)[:5] for r in spark.sql("SELECT * FROM windows").collect())
    assert got == sorted(tuple(r)[:5] for r in batch.collect()) and len(got) == 20


def test_fusion_of_micro_batches(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "b")], "ranking int, position int, key string")
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = running_fusion(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda d, n: seen.extend(r["key"] for r in d.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == ["b", "a"]
