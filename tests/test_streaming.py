from pyspark.sql import functions as F

from tracewell.streaming import ledger as S


def test_append_and_counts(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("occurrence_id"), F.lit("s").alias("source"), F.col("id").cast("double").alias("value"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    schema = "occurrence_id string, source string, value double, ts timestamp"
    for _ in range(2):  # the second run has nothing new
        S.append_ledger(S.occurrence_stream(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    q = S.step_counts(S.occurrence_stream(spark, str(tmp_path / "in"), schema), "ts").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r["n"] for r in spark.sql("select * from counts").collect()) == 100
