from strandwork.streaming.counts import windowed_counts, with_gc


def test_streams(spark, tmp_path):
    spark.sql("SELECT timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts, CAST(id % 2 AS STRING) AS kind, 'GATC' AS sequence FROM range(30)").write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    assert with_gc(stream).isStreaming
    q = windowed_counts(with_gc(stream), "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    rows = {(r.start.minute, r.kind): r.n for r in spark.table("counts").collect()}
    assert rows == {(m, k): 5 for m in (0, 10, 20) for k in "01"}
