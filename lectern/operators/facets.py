"""Library statistics and faceted breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LONG_TAIL = 20
PARTS = 32


def stats(books: DataFrame) -> DataFrame:
    """Counts by reading status and hours of what is not deleted."""
    live = books.where("deleted_at IS NULL")
    status = lambda s: F.count_if(F.col("reading_status") == s)
    done = F.when(F.col("reading_status") == "finished", F.col("duration_ms"))
    return live.agg(
        F.count("*").alias("total"), status("unread").alias("unread"), status("reading").alias("reading"), status("finished").alias("finished"),
        status("dnf").alias("dnf"), (F.coalesce(F.sum(done), F.lit(0)) / 3.6e6).alias("hours"), (F.coalesce(F.avg(done), F.lit(0.0)) / 3.6e6).alias("mean_hours"),
    )


def length_bucket(ms: Column) -> Column:
    h = ms / 3_600_000
    return F.when(ms.isNull(), "unknown").when(h < 4, "<4h").when(h < 8, "4-8h").when(h < 15, "8-15h").when(h < 25, "15-25h").otherwise("25h+")


def decade(release: Column) -> Column:
    """The decade of a date that starts with a year; others are unknown."""
    year = F.try_to_number(F.regexp_extract(F.substring(release, 1, 4), r"^\s*[+-]?\d+", 0), F.lit("9999"))
    known = release.isNotNull() & (F.char_length(release) >= 4) & (F.coalesce(year, F.lit(0)) != 0)
    return F.when(known, F.concat(F.substring(release, 1, 3), F.lit("0s"))).otherwise("unknown")


def breakdown(rows: DataFrame, label: Column, key: Column | None = None, by_label: bool = False, most: int = LONG_TAIL) -> DataFrame:
    """(label, count, percentage) of groups of `key` (of the label, if none is given). Of more than `most` groups
    those past it in order (largest first, or labels from the last) are one, Others."""
    groups = rows.select((label if key is None else key).alias("key"), label.alias("label")).groupBy("key", "label").agg(F.count("*").alias("count"))
    order = [F.col("label").desc_nulls_last(), "key"] if by_label else [F.desc("count"), F.col("label").asc_nulls_last(), "key"]
    # Groups are made once. Each of PARTS parts keeps its first ones and a sum of its rest; what is then ranked together is
    # a bounded number of rows.
    part = F.pmod(F.xxhash64("key", "label"), F.lit(PARTS))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    few = groups.withColumn("part", part).withColumn("slot", F.least(nth, F.lit(most + 1)))
    few = few.groupBy("part", "slot").agg(F.first("key").alias("key"), F.first("label").alias("label"), F.sum("count").alias("count"), (F.col("slot") > most).alias("rest"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rest", *order))
    slots = few.withColumn("slot", F.when(F.col("rest"), most + 1).otherwise(F.least(place, F.lit(most + 1))))
    out = slots.groupBy("slot").agg(F.when(F.first("slot") > most, "Others").otherwise(F.first("label")).alias("label"), F.sum("count").alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return out.select("label", "count", F.round(F.col("count") * 100.0 / total, 4).alias("percentage"))


def finished_since(books: DataFrame, progress: DataFrame, start: Column) -> DataFrame:
    """How many books that aren't deleted were finished and last heard from `start` on."""
    done = progress.where(F.col("is_finished") & (F.col("last_listened_at") >= start)).select("book_id").distinct()
    return books.where("deleted_at IS NULL").join(done, "book_id", "left_semi").agg(F.count("*").alias("finished_since"))
