from pyspark.sql import functions as F

from strandline.streaming import coverage


def test_window_depth_grows_with_the_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("a", 0, 10), ("a", 8, 25), ("b", 19, 21), ("b", 5, 5)]
    spark.createDataFrame(rows[:2], coverage.INTERVALS).write.parquet(folder)
    stream = coverage.window_depth(coverage.interval_stream(spark, folder), 10)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("depth").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame(rows[2:], coverage.INTERVALS).write.mode("append").parquet(folder)
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.table("depth").collect())
    finally:
        q.stop()
    assert got == [("a", 0, 12), ("a", 10, 10), ("a", 20, 5), ("b", 10, 1), ("b", 20, 1)]
    batch = coverage.window_depth(spark.createDataFrame(rows, coverage.INTERVALS), 10)
    assert sorted(tuple(r) for r in batch.collect()) == got


def test_bases_by_time_drops_late_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = coverage.INTERVALS + ", at timestamp"

    def add(*rows):
        df = spark.createDataFrame([("a", 0, n, m) for n, m in rows], "contig string, start0 bigint, end0 bigint, m string")
        df.select("contig", "start0", "end0", F.to_timestamp(F.concat(F.lit("2024-01-01 00:"), "m")).alias("at")).write.mode("append").parquet(folder)

    add((5, "01:00"), (6, "02:00"))
    stream = coverage.bases_by_time(coverage.interval_stream(spark, folder, schema), "at")
    q = stream.writeStream.outputMode("append").format("memory").queryName("times").start()
    try:
        q.processAllAvailable()
        add((1, "40:00"))
        q.processAllAvailable()
        add((9, "03:00"), (2, "59:00"))
        q.processAllAvailable()
        got = [(r.reads, r.bases) for r in spark.table("times").orderBy("begin").collect()]
    finally:
        q.stop()
    assert got[0] == (2, 11)
