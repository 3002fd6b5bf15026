from pyspark.sql import functions as F

from sievra.streaming import quality


def test_streams(spark, tmp_path):
    data = [(1, "2024-01-01 00:01:00", " a ", "x"), (2, "2024-01-01 00:02:00", "?", "5"), (3, "2024-01-01 00:02:30", "?", "5"), (4, "2024-01-01 00:07:00", None, "15/04/2020")]
    df = spark.createDataFrame(data, "id int, t string, a string, b string").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(plan, mode, name):
        q = plan.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    got = run(quality.windowed_quality(stream, "t", columns=["a", "b"]), "complete", "w")
    assert sorted((r.window.start.minute, r.column, r.rows, r.missing, r.outer_space, r.numeric) for r in got) == [(0, "a", 3, 2, 1, 0), (0, "b", 3, 0, 0, 2), (5, "a", 1, 1, 0, 0), (5, "b", 1, 0, 0, 0)]
    assert sorted(r.id for r in run(quality.drop_repeats(stream, "t"), "append", "d")) in ([1, 2, 4], [1, 3, 4])
    assert {r.id: (r.a, r.b) for r in run(quality.clean_rows(stream, ["b"]), "append", "c")}[4] == (None, "2020-04-15")
    seen = []
    q = quality.each_batch(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert seen == [4]
