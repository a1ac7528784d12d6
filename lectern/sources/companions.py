"""Companion files: e-books and comics beside a book, known by extension and by their first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of companion files (fixed values).
EXTENSIONS = ["epub", "pdf", "mobi", "azw3", "azw", "kfx", "fb2", "lit", "djvu", "djv", "lrf", "cbz", "cbr", "cb7", "cbt"]

#: First bytes of formats (fixed values).
MAGIC = {"pdf": b"%PDF", "cbr": b"Rar!\x1a\x07", "cb7": b"7z\xbc\xaf\x27\x1c", "kfx": b"\xeaDRMION!", "lit": b"ITOLITLS"}


def companion_format(head: Column) -> Column:
    """The format that a file's first 512 bytes or more show; null if none."""
    at = lambda place, mark: F.substring(head, place + 1, len(mark)) == F.lit(mark)
    within = lambda n, mark: F.contains(F.substring(head, 1, n), F.lit(mark))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, mark in MAGIC.items():
        out = out.when(at(0, mark), name)
    out = out.when(at(60, b"BOOKMOBI"), "mobi").when((F.octet_length(head) >= 263) & at(257, b"ustar"), "cbt")
    zipped = at(0, b"PK\x03\x04")
    out = out.when(zipped & within(256, b"mimetype") & within(256, b"application/epub+zip"), "epub").when(zipped, "cbz")
    return out.when(at(0, b"<?xml") & within(512, b"<FictionBook"), "fb2").when(at(0, b"AT&TFORM") & within(512, b"DJVU"), "djvu")


def companion_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, format, sha256) of companion files under a folder, by extension in any case and then by their bytes; those
    whose bytes show no format are left out. Files of other extensions aren't opened."""
    any_case = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in EXTENSIONS]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(any_case)}}}").load(root)
    return rows.select("path", F.col("length").alias("size"), companion_format(F.col("content")).alias("format"), F.sha2("content", 256).alias("sha256")).where("format IS NOT NULL")
