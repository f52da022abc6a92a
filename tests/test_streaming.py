import datetime

from pyspark.sql import functions as F

from loomsieve.streaming import events


def _rows(spark, folder, rows, name):
    spark.createDataFrame(rows, "key string, ts timestamp, v int").coalesce(1).write.mode("append").parquet(str(folder / name))


def test_windows_upserts_and_dead_letters(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    _rows(spark, tmp_path, [("a", t(0), 1), ("a", t(3), 2), ("b", t(12), 30)], "in")
    stream = spark.readStream.schema("key string, ts timestamp, v int").parquet(str(tmp_path / "in"))
    q = events.windowed_counts(stream, "ts", "5 minutes", "10 minutes", ["key"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["key"], r["n"]) for r in spark.table("w").collect()) == [("a", 2), ("b", 1)]
    folder = str(tmp_path / "state")
    for _ in range(2):
        sink = events.upsert_sink(spark, folder, "key", "ts")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        assert {r["key"]: r["v"] for r in events.current(spark, folder).collect()}["b"] == 30
        _rows(spark, tmp_path, [("a", t(20), 5), ("c", t(1), 6)], "in")
    stream.writeStream.foreachBatch(events.upsert_sink(spark, folder, "key", "ts")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {r["key"]: r["v"] for r in events.current(spark, folder).collect()} == {"a": 5, "b": 30, "c": 6}
    events.quarantined(stream, {"small": F.col("v") < 10}, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bad")).select("key").first()[0] == "b" and spark.read.parquet(str(tmp_path / "good")).count() == 6


def test_upserts_write_touched_buckets_and_expire_old_versions(spark, tmp_path):
    folder = str(tmp_path / "state")
    sink = events.upsert_sink(spark, folder, "key", "pos", buckets=4, keep=2)
    want = {}
    for batch in range(6):
        rows = [(f"k{i}", batch, batch * 10 + i) for i in range(batch, batch + 2)]
        want |= {k: v for k, _, v in rows}
        for _ in range(2):  # a repeated batch changes nothing
            sink(spark.createDataFrame(rows, "key string, pos int, v int"), batch)
        table = events.current(spark, folder)
        assert table.columns == ["key", "pos", "v"] and {r["key"]: r["v"] for r in table.collect()} == want
    assert events.versions(spark, folder) == list(range(6)) and all(len(p) <= 3 for p in events._by_bucket(spark, folder).values())
