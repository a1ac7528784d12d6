"""Retention and detection in two modes: a dry run reports what an apply run would change, from one plan.

Tables are versions (sources.versions). A dry run counts; an apply run writes the next version of all tables that its targets
touch and commits it in one step, or, if it fails before, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.timeline import FLOORS, applies_itself
from lectern.sources.versions import Versioned


@dataclass(frozen=True)
class Target:
    """Rows of a table that a cleanup takes. due: rows (of the table and all tables) that may go; aged: the column of their
    time, if they go only once they are `days` old; force takes them whatever their age."""

    name: str
    category: str
    table: str
    due: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
    aged: str | None = None
    days: int = 90


def settled(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Journal rows that are over."""
    return rows.where(F.col("progress").isin("done", "failed", "reversed"))


def every(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    return rows


def transcoded(files: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Active files, not m4b, of a book with another active file in m4b, that nothing holds (refs without a released_at)."""
    done = files.where("is_active and format = 'm4b'").select("book_id").distinct()
    held = tables["refs"].where("released_at is null").select("file_id").distinct()
    return files.where("is_active and format is not null and format <> 'm4b'").join(done, "book_id", "left_semi").join(held, "file_id", "left_anti")


TARGETS = (
    Target("journal", "records", "journal", settled, "created_at"),
    Target("nearby_books", "hints", "nearby", every, "discovered_at"),
    Target("transcoded_sources", "files", "files", transcoded),
)


def due(target: Target, tables: dict[str, DataFrame], now: Column, force: bool = False) -> DataFrame:
    rows = target.due(tables[target.table], tables)
    return rows if target.aged is None or force else rows.where(F.col(target.aged) < now - F.make_dt_interval(F.lit(target.days)))


def report(tables: dict[str, DataFrame], targets: tuple[Target, ...], now: Column, categories: set[str] | None = None, force: bool = False) -> DataFrame:
    """(name, category, enabled, rows): what each target would take; one of a category that isn't enabled takes none."""
    out = None
    for t in targets:
        on = categories is None or t.category in categories
        n = due(t, tables, now, force).agg(F.count("*").alias("rows")) if on else tables[t.table].where("false").agg(F.count("*").alias("rows"))
        row = n.select(F.lit(t.name).alias("name"), F.lit(t.category).alias("category"), F.lit(on).alias("enabled"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def kept(tables: dict[str, DataFrame], targets: tuple[Target, ...], keys: dict[str, str], now: Column, categories: set[str] | None = None, force: bool = False) -> dict[str, DataFrame]:
    """The tables without what the targets take; keys names each table's key column."""
    out = dict(tables)
    for t in targets:
        if categories is None or t.category in categories:
            gone = due(t, tables, now, force).select(keys[t.table]).distinct()
            out[t.table] = out[t.table].join(gone, keys[t.table], "left_anti")
    return out


def applied(store: Versioned, names: tuple[str, ...], targets: tuple[Target, ...], keys: dict[str, str], now: Column, categories: set[str] | None = None, force: bool = False) -> int:
    """Clean the tables of a versioned folder; the new version's number."""
    tables = {n: store.read(n) for n in names}
    return store.write(**kept(tables, targets, keys, now, categories, force))


def cut_ms(start: Column, end: Column, padding: Column) -> Column:
    return F.greatest(F.lit(0), end - start - padding)


def promoted(matches: DataFrame, chapters: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, chapters, books) after candidates that apply themselves were applied: matches (row_id, book_id, file_id, kind, method,
    confidence, status, start_ms, end_ms, padding_ms) become `applied`, chapters (file_id, idx, start_ms, end_ms) move up by the cuts of
    their file that end before them and shrink by those inside, books (book_id, duration_ms, audiologo_status) get shorter and
    are `applied`. Cuts of a file don't overlap: each is taken at its place before any cut, so their order doesn't matter."""
    ready = (F.col("status") == "candidate") & applies_itself(F.col("method"), F.col("confidence")) & F.col("method").isin(*[m for m, least in FLOORS.items() if least > 0])
    ready = F.coalesce(ready, F.lit(False))
    cuts = matches.where(ready).select("file_id", "book_id", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), cut_ms(F.col("start_ms"), F.col("end_ms"), F.coalesce("padding_ms", F.lit(0))).alias("cut"))
    of_file = cuts.groupBy("file_id").agg(F.collect_list(F.struct("a", "b", "cut")).alias("cuts"))  # an intro and an outro

    def less(at: Column) -> Column:
        """What cuts before a time take away."""
        return F.aggregate(F.coalesce("cuts", F.array().cast("array<struct<a:bigint,b:bigint,cut:bigint>>")), F.lit(0).cast("long"), lambda n, c: n + F.when(at >= c["b"], c["cut"]).otherwise(0))

    moved = chapters.join(of_file, "file_id", "left").withColumns({"start_ms": F.col("start_ms") - less(F.col("start_ms")), "end_ms": F.col("end_ms") - less(F.col("end_ms"))}).select(*chapters.columns)
    lost = cuts.groupBy("book_id").agg(F.sum("cut").alias("lost"))
    shorter = books.join(lost, "book_id", "left").withColumns({
        "duration_ms": F.when(F.col("lost").isNull(), F.col("duration_ms")).otherwise(F.greatest(F.lit(0), F.col("duration_ms") - F.col("lost"))),
        "audiologo_status": F.when(F.col("lost").isNull(), F.col("audiologo_status")).otherwise("applied"),
    }).select(*books.columns)
    return matches.withColumn("status", F.when(ready, "applied").otherwise(F.col("status"))), moved, shorter


def promote(store: Versioned) -> int:
    """Apply what applies itself in a versioned folder with tables matches, chapters and books; the version's number, which
    stays where nothing is to be done."""
    tables = [store.read(n) for n in ("matches", "chapters", "books")]
    out = promoted(*tables)
    if not out[0].join(tables[0].select("row_id", F.col("status").alias("was")), "row_id").where("status <> was").limit(1).count():
        return store.number()
    return store.write(matches=out[0], chapters=out[1], books=out[2])
