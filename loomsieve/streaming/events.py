"""Structured Streaming counterparts of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomsieve.operators import incremental, route


def windowed_counts(events: DataFrame, ts: str, late: str, window: str, by: list[str]) -> DataFrame:
    """Counts per event-time window; rows later than ``late`` are dropped with their window's state."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *by, "n")


def session_counts(events: DataFrame, ts: str, late: str, gap: str, by: list[str]) -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_seen(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def upsert_sink(spark: SparkSession, folder: str, key: str, pos: str, buckets: int = 64, keep: int = 3) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keeps the latest row of each key. A repeated batch is a no-op.

    Keys are dealt to buckets, and a batch writes only the buckets that it touches, as a version of its own; the newest
    whole version of each bucket is the table. An interrupted write leaves what was before. Of each bucket the last ``keep``
    versions stay, for readers that began before; older ones are deleted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        mine = f"{folder}/v={batch_id}"
        if _whole(spark, mine):
            return
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        rows = batch.withColumn("bucket", bucket)
        touched = {r[0] for r in rows.select("bucket").distinct().collect()}  # as many as buckets at most
        before = _by_bucket(spark, folder, batch_id)
        old = [paths[-1] for b, paths in before.items() if b in touched]
        if old:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("bucket", bucket))
        incremental.latest(rows, key, pos).write.mode("overwrite").partitionBy("bucket").parquet(mine)
        for b in touched:
            for path in before.get(b, [])[: -keep]:
                _path(spark, path)[1].delete(_path(spark, path)[0], True)

    return write


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _whole(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def _names(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    p, fs = _path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))


def versions(spark: SparkSession, folder: str) -> list[int]:
    return [v for v in _names(spark, folder, "v=") if _whole(spark, f"{folder}/v={v}")]


def _by_bucket(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, list[str]]:
    """The folders of each bucket, oldest first."""
    out: dict[int, list[str]] = {}
    for v in versions(spark, folder):
        if before is None or v < before:
            for b in _names(spark, f"{folder}/v={v}", "bucket="):
                out.setdefault(b, []).append(f"{folder}/v={v}/bucket={b}")
    return out


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The table as the newest version of every bucket."""
    return spark.read.parquet(*(paths[-1] for paths in _by_bucket(spark, folder).values()))


def quarantined(stream: DataFrame, rules: dict[str, Column], good: str, bad: str, checkpoint: str) -> DataStreamWriter:
    """Valid rows to one folder, the others with what they break to a dead-letter folder, in one pass per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = route.check(batch, rules).persist()
        checked.filter(F.size("violations") == 0).drop("violations").write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        checked.filter(F.size("violations") > 0).write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        checked.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
