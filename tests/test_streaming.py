"""Streams over files that come in batches."""

import datetime

import pytest

from lectern.sources.versions import Versioned
from lectern.streaming import progress

SCHEMA = "book long, at timestamp, position long"
AT = datetime.datetime(2024, 1, 1)


def batches(spark, tmp_path):
    at = lambda m: AT + datetime.timedelta(minutes=m)
    for i, rows in enumerate([[(1, at(1), 5), (2, at(1), 7), (1, at(3), 9)], [(1, at(2), 1), (3, at(1), 2)], [(2, at(1), 8), (3, at(9), 4)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        yield i


def run(spark, tmp_path, merge):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in").writeStream.foreachBatch(merge).option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start()
    stream.awaitTermination()


def test_the_last_writer_stays(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    assert progress.latest_rows(spark, path, 2) is None
    for _ in batches(spark, tmp_path):
        run(spark, tmp_path, progress.keep_latest(path, ["book"], "at", 2))
    assert sorted((r.book, r.position) for r in progress.latest_rows(spark, path, 2).collect()) == [(1, 9), (2, 8), (3, 4)]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, monkeypatch):
    path, merge = f"file://{tmp_path}/kept", None
    rows = spark.createDataFrame([(i, AT, i) for i in range(8)], SCHEMA)
    merge = progress.keep_latest(path, ["book"], "at", 2)
    whole, calls = Versioned.commit, []

    def fails_once(self, staged, after):
        calls.append(staged)
        if len(calls) == 2:
            raise OSError("lost between write and commit")
        return whole(self, staged, after)

    monkeypatch.setattr(Versioned, "commit", fails_once)
    with pytest.raises(OSError):
        merge(rows, 0)
    merge(rows, 0)
    merge(rows, 0)
    assert sorted((r.book, r.position) for r in progress.latest_rows(spark, path, 2).collect()) == [(i, i) for i in range(8)]


def test_failures_are_counted_in_windows(spark, tmp_path):
    at = lambda s: AT + datetime.timedelta(seconds=s)
    spark.createDataFrame([("a", at(1)), ("a", at(20)), ("a", at(70)), ("b", at(5))], "key string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/e")
    events = spark.readStream.schema("key string, at timestamp").parquet(f"{tmp_path}/e")
    q = progress.failure_counts(events, "key", "at", 60).writeStream.format("memory").queryName("failures").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.key, r.window.start): r.failures for r in spark.table("failures").collect()}
    assert got[("a", AT)] == 2 and got[("b", AT)] == 1 and sum(n for (k, _), n in got.items() if k == "a") == 6
