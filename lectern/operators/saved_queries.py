"""Stored queries: filters kept as JSON, all executed in one scan of the catalogue.

A stored filter is data, a struct of optional conditions. Filters are taken in blocks of BLOCK; a block is a constant of the
plan, and each book keeps the ids of those whose conditions it meets, so books are scanned once a block and only matches go
on. A page of each query is cut by windows in two steps: the best of PARTS parts of its matches, then the best of
those, so a query that matches most books isn't one task's work.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.codes import ascii_lower
from lectern.operators.catalog import DEFAULT_ROWS, MOST_ROWS

BLOCK, PARTS = 256, 32
#: The fields that a stored filter may have (fixed values).
FILTER = (
    "q string, author string, series string, language array<string>, min_duration_secs bigint, max_duration_secs bigint, abridged boolean, "
    "imported_after_unix bigint, imported_before_unix bigint, include_deleted boolean, sort struct<dim: string, dir: string>, `limit` bigint, `offset` bigint"
)
FIELDS = ("q", "author", "series", "language", "min_duration_secs", "max_duration_secs", "abridged", "imported_after_unix", "imported_before_unix", "include_deleted", "sort", "limit", "offset")
DIMS, DIRS = ("book_id", "title", "imported_at"), ("asc", "desc")
_BAD = "_bad string"


def parsed(stored: DataFrame) -> DataFrame:
    """stored (query_id, query_json, sort_json) with `filter`, and `valid`: a text that isn't JSON of these fields and types, and
    a sort that doesn't exist, is none. The stored sort stands over the filter's own."""
    keep = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = stored.withColumn("filter", F.from_json("query_json", f"{FILTER}, {_BAD}", keep)).withColumn("own_sort", F.from_json("sort_json", f"dim string, dir string, {_BAD}", keep))
    known = F.forall(F.coalesce(F.json_object_keys("query_json"), F.array()), lambda k: k.isin(*FIELDS))
    whole = F.col("filter").isNotNull() & F.col("filter._bad").isNull() & F.json_object_keys("query_json").isNotNull() & known
    sort = F.when(F.col("sort_json").isNotNull(), F.struct("own_sort.dim", "own_sort.dir")).otherwise(F.col("filter.sort"))
    sort = F.coalesce(sort, F.struct(F.lit("book_id").alias("dim"), F.lit("asc").alias("dir")))
    good = lambda s: F.coalesce(s["dim"].isin(*DIMS) & s["dir"].isin(*DIRS), F.lit(False))
    sorts = good(sort) & (F.col("filter.sort").isNull() | good(F.col("filter.sort"))) & F.col("own_sort._bad").isNull()
    rows = rows.withColumn("valid", F.coalesce(whole & sorts, F.lit(False)))
    return rows.select("query_id", "valid", F.when(F.col("valid"), F.col("filter").dropFields("_bad").withField("sort", sort)).alias("filter"))


def holds(f: Column) -> Column:
    """Whether a row of the catalogue meets a filter; an absent or empty condition holds."""
    def like(name: str, column: str) -> Column:
        low = ascii_lower(F.col(column))
        wanted = ascii_lower(f[name])
        wild = F.contains(wanted, F.lit("%")) | F.contains(wanted, F.lit("_"))
        hit = F.when(wild, F.like(low, F.concat(F.lit("%"), F.replace(wanted, F.lit("\\"), F.lit("\\\\")), F.lit("%")))).otherwise(F.contains(low, wanted))
        return f[name].isNull() | (f[name] == "") | F.coalesce(hit, F.lit(False))

    def least(name: str, column: Column, scale: int = 1) -> Column:
        return f[name].isNull() | F.coalesce(column >= f[name] * scale, F.lit(False))

    def most(name: str, column: Column, scale: int = 1) -> Column:
        return f[name].isNull() | F.coalesce(column <= f[name] * scale, F.lit(False))

    duration, created = F.col("duration_ms"), F.unix_seconds(F.col("created_at").cast("timestamp"))
    return (
        (F.coalesce(f["include_deleted"], F.lit(False)) | F.col("deleted_at").isNull())
        & like("q", "title") & like("author", "author") & like("series", "series")
        & (f["language"].isNull() | (F.size(f["language"]) == 0) | F.coalesce(F.array_contains(f["language"], F.col("language")), F.lit(False)))
        & least("min_duration_secs", duration, 1000) & most("max_duration_secs", duration, 1000)
        & (f["abridged"].isNull() | F.coalesce(F.col("abridged") == f["abridged"], F.lit(False)))
        & least("imported_after_unix", created) & most("imported_before_unix", created)
    )


def matches(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, dim, dir, limit, offset, and the columns of rows) for each valid query that a row meets."""
    n = queries.where("valid").count()
    blocks = max(1, -(-n // BLOCK))
    out = None
    for block in range(blocks):
        own = queries.where("valid").where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "filter")
        stored = [json.loads(r[0]) for r in own.select(F.to_json(F.struct("query_id", "filter"))).orderBy("query_id").collect()]
        constant = F.from_json(F.lit(json.dumps(stored)), f"array<struct<query_id: bigint, filter: struct<{FILTER}>>>")
        met = F.transform(F.filter(constant, lambda q: holds(q["filter"])), lambda q: F.struct(
            q["query_id"].alias("query_id"), q["filter"]["sort"].alias("sort"), q["filter"]["limit"].alias("limit"), q["filter"]["offset"].alias("offset")))
        found = rows.withColumn("met", F.explode(met)).select("met.query_id", "met.sort.dim", "met.sort.dir", F.col("met.limit").alias("most"), F.col("met.offset").alias("skip"), *rows.columns)
        out = found if out is None else out.unionByName(found)
    return out


def counted(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, valid, total): how many rows each query has, whatever its page; null for one that isn't valid."""
    totals = matches(rows, queries).groupBy("query_id").agg(F.count("*").alias("total"))
    return queries.select("query_id", "valid").join(totals, "query_id", "left").withColumn("total", F.when(F.col("valid"), F.coalesce("total", F.lit(0))))


def executed(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, place, and the columns of rows): the page of each valid query, in its order; ties by book_id."""
    found = matches(rows, queries)
    end = F.least(F.greatest(F.coalesce("most", F.lit(DEFAULT_ROWS)), F.lit(0)), F.lit(MOST_ROWS)) + F.greatest(F.coalesce("skip", F.lit(0)), F.lit(0))
    found = found.withColumn("end", end).withColumn("part", F.pmod(F.xxhash64("book_id"), F.lit(PARTS)))
    text = F.when(F.col("dim") == "title", F.col("title"))
    number = F.when(F.col("dim") == "book_id", F.col("book_id")).when(F.col("dim") == "imported_at", F.unix_micros(F.col("created_at").cast("timestamp")))
    found = found.withColumn("_text", text).withColumn("_number", number)
    pages = None
    for way in DIRS:
        by = [F.col(c).asc() if way == "asc" else F.col(c).desc() for c in ("_text", "_number")] + [F.col("book_id")]
        own = found.where(F.col("dir") == way)
        own = own.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*by))).where("place <= end")
        own = own.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where("place <= end")
        pages = own if pages is None else pages.unionByName(own)
    skip = F.greatest(F.coalesce("skip", F.lit(0)), F.lit(0))
    return pages.withColumn("place", (F.col("place") - skip).cast("int")).where("place > 0").select("query_id", "place", *rows.columns)
