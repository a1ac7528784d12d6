"""The catalogue query: a filter of optional predicates, the list and its count, entity lists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.codes import ascii_lower

MOST_ROWS, DEFAULT_ROWS = 500, 100


@dataclass(frozen=True)
class CatalogueFilter:
    """An absent or empty field is no predicate."""

    q: str | None = None
    author: str | None = None
    series: str | None = None
    language: list[str] = field(default_factory=list)
    min_duration_secs: int | None = None
    max_duration_secs: int | None = None
    abridged: bool | None = None
    imported_after: str | None = None
    imported_before: str | None = None
    include_deleted: bool = False
    sort: str = "book_id"
    descending: bool = False
    limit: int | None = None
    offset: int = 0


def like(column: Column, text: str) -> Column:
    """LIKE %text% in any ASCII case; % and _ in the text are wildcards, a backslash is not an escape."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return ascii_lower(column).like("%" + low.replace("\\", "\\\\") + "%")


def predicates(f: CatalogueFilter) -> Column:
    out = F.lit(True)
    if not f.include_deleted:
        out = out & F.col("deleted_at").isNull()
    if f.q:
        out = out & like(F.col("title"), f.q)
    if f.author:
        out = out & like(F.col("author"), f.author)
    if f.series:
        out = out & like(F.col("series"), f.series)
    if f.language:
        out = out & F.col("language").isin(f.language)
    if f.min_duration_secs is not None:
        out = out & (F.col("duration_ms") >= f.min_duration_secs * 1000)
    if f.max_duration_secs is not None:
        out = out & (F.col("duration_ms") <= f.max_duration_secs * 1000)
    if f.abridged is not None:
        out = out & (F.col("abridged") == f.abridged)
    if f.imported_after:
        out = out & (F.col("created_at") >= F.lit(f.imported_after).cast("timestamp_ntz"))
    if f.imported_before:
        out = out & (F.col("created_at") <= F.lit(f.imported_before).cast("timestamp_ntz"))
    return out


def display_names(entities: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """entities (key, name) with `display`: the prime alias (of several, the first in order), else the name."""
    prime = aliases.where("is_prime").groupBy(key).agg(F.min("alias").alias("prime"))
    return entities.join(prime, key, "left").withColumn("display", F.coalesce("prime", "name")).drop("prime")


def catalogue(books: DataFrame, authors: DataFrame, series: DataFrame, book_series: DataFrame) -> DataFrame:
    """books with the names of their author and primary series; a book of two primaries comes twice."""
    primary = book_series.where("is_primary").select("book_id", "series_id", "position")
    return (
        books.join(authors.select("author_id", F.col("display").alias("author")), "author_id", "left")
        .join(primary, "book_id", "left").join(series.select("series_id", F.col("display").alias("series")), "series_id", "left")
    )


def listed(rows: DataFrame, f: CatalogueFilter) -> DataFrame:
    """A page of the catalogue: sorted by the filter's column, then book_id."""
    key = F.col(f.sort)
    most = min(MOST_ROWS, DEFAULT_ROWS if f.limit is None else max(0, f.limit))
    out = rows.where(predicates(f)).orderBy(key.desc() if f.descending else key.asc(), "book_id")
    return out.offset(f.offset).limit(most) if f.offset else out.limit(most)


def counted(rows: DataFrame, f: CatalogueFilter) -> DataFrame:
    """How many rows the filter has, whatever the page."""
    return rows.where(predicates(f)).agg(F.count("*").alias("total"))


def joined_names(members: DataFrame, key: str, name: str, alias: str) -> DataFrame:
    """Per key, the distinct names joined by a comma, in order."""
    return members.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(name)), ", ").alias(alias))


def entity_list(entities: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Entities with the number of their books, pre-aggregated before the join."""
    counts = members.groupBy(key).agg(F.count("*").alias("book_count"))
    return entities.join(counts, key, "left").withColumn("book_count", F.coalesce("book_count", F.lit(0)))
