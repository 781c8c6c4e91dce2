"""The table of changes: late and repeated events, restarts, expiry of state, and compactions that change nothing."""

from datetime import datetime, timedelta

import pytest

from hearthline.streaming import sightings

START = datetime(2024, 1, 1)
SCHEMA = "id long, k string, at timestamp, p string"


def day(n):
    return START + timedelta(days=n)


@pytest.fixture
def table(spark, tmp_path):
    """Feeds batches of events, one stream run each, and gives the last progress of the run."""
    source, path, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def feed(*events):
        spark.createDataFrame(list(events), SCHEMA).coalesce(1).write.mode("append").json(source)
        run = sightings.keep_changes(spark.readStream.schema(SCHEMA).json(source), "k", "at", "p", ["id"], path, checkpoint, "2 days")
        run.awaitTermination()
        return run.recentProgress

    def now():
        return {r.k: (r.first_seen, r.last_seen, r.sightings, r.latest) for r in sightings.current(spark, path, "k").collect()}

    return feed, now, path


def test_events_count_once(spark, table):
    feed, now, path = table
    feed((1, "a", day(0), "x"), (2, "a", day(1), "y"), (1, "a", day(0), "x"), (3, None, day(0), "z"), (4, "b", None, "z"))
    assert now() == {"a": (day(0), day(1), 2, "y")}
    feed((2, "a", day(1), "y"), (5, "b", day(1), "b"), (6, "a", day(0.5), "before"))  # a repeat, another key, and one that comes late but not too late
    want = {"a": (day(0), day(1), 3, "y"), "b": (day(1), day(1), 1, "b")}
    assert now() == want
    feed((7, "b", day(20), "far"))
    feed((8, "a", day(2), "too late"), (9, "b", day(20), "gar"))
    want["b"] = (day(1), day(20), 3, "gar")  # of equal times the greatest payload
    assert now() == want
    assert sightings.compact(spark, path, "k") >= 3 and now() == want
    assert not [n for n in sightings._entries(spark, f"{path}/changes") if "=" in n]
    feed((10, "c", day(21), "c"), (9, "b", day(20), "gar"))  # goes on from the checkpoint: known repeats are still known
    want["c"] = (day(21), day(21), 1, "c")
    assert now() == want
    first = sightings.compact(spark, path, "k")
    assert now() == want and sightings.compact(spark, path, "k") == first and now() == want


def test_state_expires(table):
    feed, _, _ = table
    feed(*((i, f"k{i}", day(i / 100), "x") for i in range(100)))
    feed((1000, "late", day(50), "x"))
    last = feed((1001, "later", day(51), "x"))
    held = [s["numRowsTotal"] if isinstance(s, dict) else s.numRowsTotal for p in last for s in p["stateOperators"]]
    assert held[-1] <= 2  # of a hundred ids none is kept


def test_a_broken_compaction_and_a_repeated_batch(spark, table):
    feed, now, path = table
    feed((1, "a", day(0), "x"))
    feed((2, "a", day(0.1), "y"))
    want = now()
    (spark.createDataFrame([("a", day(9), day(9), 99, "wrong")], "k string, first_seen timestamp, last_seen timestamp, sightings long, latest string").write.parquet(f"{path}/base/upto=7"))
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/base/upto=7/_SUCCESS")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).delete(marker, False)  # a base that was never committed
    assert now() == want
    assert sightings.compact(spark, path, "k") < 7 and now() == want


def test_no_batches(spark, tmp_path):
    with pytest.raises(ValueError):
        sightings.current(spark, f"{tmp_path}/nothing", "k")
    assert sightings.compact(spark, f"{tmp_path}/nothing", "k") == -1
