"""Sightings of listings as a stream: first and last time seen, how often, and the latest payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearthline.operators.quality import upsert


def state(events: DataFrame, key: str, at: str, payload: str) -> DataFrame:
    """The aggregate of upsert() over a stream; the state is one row per key."""
    return upsert(events, key, at, payload)


def keep_table(events: DataFrame, key: str, at: str, payload: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the state as a Parquet table of changes under path: every batch adds a folder of the keys that it changed, and latest() reads the last state of each. A repeated batch replaces its folder."""

    def put(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return state(events, key, at, payload).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, path: str, key: str) -> DataFrame:
    """The last state of each key."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (key, "batch"))), "batch").alias("s")).select(key, "s.*")


def windowed_counts(events: DataFrame, at: str, kind: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by kind and window; rows later than the watermark are dropped from a stream (a batch has none)."""
    return events.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), kind).count().select(F.col("w.start").alias("start"), kind, "count")


# A table without a growing state: repeats are dropped within a watermark, batches are written as changes, and changes are merged into a base.


def _entries(spark: SparkSession, path: str) -> dict[str, object]:
    """The folders under path by name, with Hadoop's file system that has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName(): s.getPath() for s in fs.listStatus(at)} if fs.exists(at) else {}


def _drop(spark: SparkSession, paths: list) -> None:
    for p in paths:
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _whole(spark: SparkSession, found: dict[str, object]) -> list[int]:
    """The numbers of the folders whose writing was committed, in order."""
    done = [(int(name.partition("=")[2]), p) for name, p in found.items() if "=" in name]
    return sorted(n for n, p in done if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _parts(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The batch up to which the newest whole base holds all changes (-1 without one), and the later whole batches."""
    bases = _whole(spark, _entries(spark, f"{path}/base"))
    upto = bases[-1] if bases else -1
    return upto, [n for n in _whole(spark, _entries(spark, f"{path}/changes")) if n > upto]


def keep_changes(events: DataFrame, key: str, at: str, payload: str, event_id: list[str], path: str, checkpoint: str, late: str = "2 days") -> StreamingQuery:
    """Write every batch of a stream as changes under path: per key the first and last time, the number of sightings and the latest payload (of equal times the greatest).

    Events that come again (equal ``event_id``) within ``late`` of the first count once, and events later than that behind the newest time are left out; the stream's state holds the ids
    of that span alone and expires with it. Rows without a key or time are skipped. A batch that is run again after a failure replaces its folder, and a restart from the checkpoint goes on after the last batch, so
    every event counts once. current() reads the table, compact() keeps it short.
    """
    once = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late).dropDuplicatesWithinWatermark(event_id)

    def put(batch: DataFrame, number: int) -> None:
        if number > _parts(batch.sparkSession, path)[0]:  # else a base holds it already
            upsert(batch, key, at, payload).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    return once.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _merged(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("sightings").alias("sightings"), F.max(F.struct("last_seen", "latest"))["latest"].alias("latest"))


def _read(spark: SparkSession, path: str, upto: int, later: list[int]) -> DataFrame | None:
    paths = [f"{path}/base/upto={upto}"] * (upto >= 0) + [f"{path}/changes/batch={n}" for n in later]
    return spark.read.parquet(*paths) if paths else None


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key, first_seen, last_seen, sightings and latest of all batches written so far. Sums of changes, so it is equal before and after a compaction."""
    rows = _read(spark, path, *_parts(spark, path))
    if rows is None:
        raise ValueError(f"no batch has been written under {path}")
    return _merged(rows, key)


def compact(spark: SparkSession, path: str, key: str) -> int:
    """Merge the newest base and all later changes into a new base, and give the batch up to which it holds them (-1 if there are none).

    The new base counts once its folder is committed; a compaction that fails before leaves the table as it was. Then the merged changes go, and bases older than the one merged, which readers may still have open.
    """
    upto, later = _parts(spark, path)
    if later:
        _merged(_read(spark, path, upto, later), key).write.mode("overwrite").parquet(f"{path}/base/upto={later[-1]}")
    now = later[-1] if later else upto
    for folder, gone in ((f"{path}/changes", lambda n: n <= now), (f"{path}/base", lambda n: n < upto)):
        _drop(spark, [p for name, p in _entries(spark, folder).items() if "=" in name and gone(int(name.partition("=")[2]))])
    return now
