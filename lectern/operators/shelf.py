"""What a shelf shows and keeps: items for players, matches to review, the ledger of unpacked archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.codes import media_type


def review_list(matches: DataFrame, files: DataFrame, books: DataFrame, signatures: DataFrame) -> DataFrame:
    """Candidate matches (row_id, file_id, signature_id, kind, confidence, status) with their file's book and title, and the signature's
    name, null where the match has none or an unknown one. Matches of unknown files or books are left out."""
    rows = matches.where("status = 'candidate'").join(files.select("file_id", "book_id"), "file_id").join(books.select("book_id", "title"), "book_id")
    names = signatures.select("signature_id", F.col("name").alias("signature"))
    return rows.join(names, "signature_id", "left").select("book_id", "title", "file_id", "row_id", "kind", "confidence", "signature_id", "signature")


def _seconds(ms: Column) -> Column:
    return F.when(ms > 0, ms / 1000.0).otherwise(F.lit(0.0)).cast("double")


def player_items(books: DataFrame, authors: DataFrame, publishers: DataFrame, narrators: DataFrame, files: DataFrame, library: str = "default") -> DataFrame:
    """(book_id, item) in the JSON shape that players ask for: a book's tags, its active files (book_id, file_id, path, size, format,
    duration_ms, is_active) by file_id (repeated ones by path, size and duration), and its narrators (book_id, name) by name. Absent values have no key; a book
    without active files has an empty list and no cover."""
    own = files.where("is_active").select("book_id", "file_id", F.struct(
        F.col("file_id").cast("string").alias("ino"),
        F.struct(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "size").alias("metadata"),
        _seconds(F.col("duration_ms")).alias("duration"),
        media_type(F.col("format")).alias("mimeType"),
    ).alias("file"))
    own = own.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_id", "file"))), lambda x: x["file"]).alias("audioFiles"))
    read_by = narrators.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("narratorName"))
    rows = books.join(authors.select("author_id", F.col("name").alias("authorName")), "author_id", "left")
    rows = rows.join(publishers.select("publisher_id", F.col("name").alias("publisher")), "publisher_id", "left")
    rows = rows.join(read_by, "book_id", "left").join(own, "book_id", "left")
    tags = ["title", "subtitle", "authorName", "narratorName", "description", "publisher", "language", "isbn", "asin"]
    metadata = F.struct(*[F.col(t) for t in tags if t in rows.columns], F.substring_index("release_date", "-", 1).alias("publishedYear"))
    cover = F.when(F.col("audioFiles").isNotNull(), F.concat(F.lit("/api/items/"), F.col("book_id").cast("string"), F.lit("/cover")))
    media = F.struct(metadata.alias("metadata"), _seconds(F.col("duration_ms")).alias("duration"), F.coalesce("audioFiles", F.array()).alias("audioFiles"), cover.alias("coverPath"))
    item = F.struct(F.col("book_id").cast("string").alias("id"), F.lit(library).alias("libraryId"), F.lit("book").alias("mediaType"), media.alias("media"))
    return rows.select("book_id", F.to_json(item).alias("item"))


def archive_ledger(ledger: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """ledger (archive_id, source_path, source_hash, bytes_in, extracted_at) after runs (run_id, source_path, source_hash, bytes_in): the
    last run of a path replaces what is kept of it, at now, and leaves its archive_id; a new path's is null until the
    store deals one. Of equal run_ids the greatest hash wins. Runs of a path are reduced before they are joined."""
    last = runs.groupBy("source_path").agg(F.max_by(F.struct("source_hash", "bytes_in"), F.struct("run_id", "source_hash", "bytes_in")).alias("run"))
    rows = ledger.join(last, "source_path", "full")
    ran = F.col("run").isNotNull()
    pick = lambda c: F.when(ran, F.col(f"run.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("archive_id", "source_path", pick("source_hash"), pick("bytes_in"), F.when(ran, now).otherwise(F.col("extracted_at")).alias("extracted_at"))
