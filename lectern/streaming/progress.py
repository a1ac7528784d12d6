"""Streams: the last writer's progress and a failure limit, as Structured Streaming (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.versions import Versioned


def failure_counts(events: DataFrame, key: str, at: str, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Failures per key in sliding windows, late rows accepted within the watermark."""
    return events.withWatermark(at, late).groupBy(key, F.window(at, f"{seconds} seconds", f"{max(1, seconds // 2)} seconds")).agg(F.count("*").alias("failures"))


#: Parts that a table of last rows is dealt into by its key; a batch rewrites those that it has keys of.
PARTS = 64


def keep_latest(path: str, key: list[str], at: str, parts: int = PARTS):
    """For foreachBatch: merges each batch into the versioned folder at `path`, which holds the last row of each key (the larger row, of
    equal times). The rows are dealt into parts by key, each a version of its own folder; a batch writes the parts that it has keys
    of and commits them one by one. A batch that comes again after a failure gives the same rows, so no part takes it twice."""
    from lectern.operators.state import latest

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = [F.desc(at), *[F.desc(c) for c in batch.columns if c not in (*key, at)]]
        part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
        new = latest(batch, key, order).withColumn("_part", part).persist()
        for (n,) in new.select("_part").distinct().orderBy("_part").collect():
            table = Versioned(spark, f"{path}/part-{n:04}")
            rows, old = new.where(F.col("_part") == n).drop("_part"), table.read()
            table.write(rows=rows if old is None else latest(old.unionByName(rows), key, order))
        new.unpersist()

    return merge


def latest_rows(spark, path: str, parts: int = PARTS) -> DataFrame | None:
    """What keep_latest holds now, None before the first batch."""
    out = None
    for n in range(parts):
        rows = Versioned(spark, f"{path}/part-{n:04}").read()
        if rows is not None:
            out = rows if out is None else out.unionByName(rows)
    return out
