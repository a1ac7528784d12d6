"""Readers and writers of the library's formats, as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.scalar import split_values

#: Extensions of audio files (fixed values).
AUDIO = ["m4b", "m4a", "mp3", "flac", "opus", "ogg", "aax"]


def audio_files(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """Audio files under a folder: path, parent, name, extension, size, modified. Contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    rows = rows.withColumns({"parent": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "name": F.regexp_extract("path", r"([^/]*)$", 1), "extension": F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))})
    out = F.col("extension").isin(AUDIO)
    for glob in excludes or []:
        pattern = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() else c) for c in glob)
        out = out & ~F.col("path").rlike(f"(?:^|/){pattern}(?:/|$)")
    return rows.where(out)


def books_of(files: DataFrame) -> DataFrame:
    """(parent, title, files): a folder of two or more files of one extension is a book, else each file is one."""
    folder = files.groupBy("parent").agg(F.count("*").alias("n"), F.count_distinct("extension").alias("kinds"), F.collect_list("path").alias("paths"), F.collect_list("name").alias("names"))
    whole = (F.col("n") >= 2) & (F.col("kinds") == 1)
    many = folder.where(whole).select("parent", F.regexp_extract("parent", r"([^/]*)$", 1).alias("title"), F.array_sort("paths").alias("files"))
    single = folder.where(~whole).select("parent", F.explode("paths").alias("p")).select("parent", F.regexp_replace(F.regexp_extract("p", r"([^/]*)$", 1), r"\.[^.]*$", "").alias("title"), F.array("p").alias("files"))
    return many.unionByName(single)


HEAD = 4096


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri)) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def content_key(files: DataFrame) -> DataFrame:
    """files (path, size, modified) with a key of size, time of change and the first 4096 bytes. A task opens each file and reads
    these bytes and no more, whatever its size; one that can't be read has no key."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri in batch.column(batch.schema.names.index("path")).to_pylist():
                try:
                    where, path = opened(uri)
                    with where.open_input_file(path) as file:
                        out.append(file.read(HEAD))
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "_head"])

    schema = T.StructType([*files.schema.fields, T.StructField("_head", T.BinaryType())])
    read = files.mapInArrow(heads, schema)
    key = F.sha2(F.concat(F.col("size").cast("string").cast("binary"), F.unix_micros("modified").cast("string").cast("binary"), F.col("_head")), 256)
    return read.withColumn("content_key", key).drop("_head")


def moved(known: DataFrame, seen: DataFrame) -> DataFrame:
    """seen (path, content_key) against known: PathKnown, else Moved (with the old path), else Inserted."""
    paths = known.select("path", F.lit(True).alias("there"))
    keys = known.groupBy("content_key").agg(F.min("path").alias("old_path"))
    rows = seen.join(paths, "path", "left").join(keys, "content_key", "left")
    state = F.when(F.col("there"), "PathKnown").when(F.col("old_path").isNotNull(), "Moved").otherwise("Inserted")
    return rows.select("path", "content_key", state.alias("state"), F.when(state == "Moved", F.col("old_path")).alias("old_path"))


def paired(companions: DataFrame, books: DataFrame) -> DataFrame:
    """companions (path) with the books (dir, book_id) whose folder is an ancestor of theirs: unpaired, paired or
    ambiguous. A path's ancestors become rows, so the join is on equal paths."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hits = companions.select("path", F.explode(ancestors).alias("dir")).join(books, "dir").groupBy("path").agg(F.array_sort(F.collect_set("book_id")).alias("books"))
    rows = companions.join(hits, "path", "left").withColumn("n", F.coalesce(F.size("books"), F.lit(0)))
    return rows.select("path", F.when(F.col("books").isNull(), "unpaired").when(F.col("n") == 1, "paired").otherwise("ambiguous").alias("state"), "books")


def box_sets(books: DataFrame, root: str, existing: DataFrame) -> DataFrame:
    """(folder, books) of folders, other than the root, that hold two books' folders or more and aren't a collection yet."""
    up = F.regexp_extract("dir", r"^(.*)/[^/]*$", 1)
    groups = books.groupBy(up.alias("folder")).agg(F.count("*").alias("books")).where((F.col("books") >= 2) & (F.col("folder") != root))
    nested = groups.select(F.regexp_extract("folder", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()
    return groups.join(nested, "folder", "left_anti").join(existing.select("folder"), "folder", "left_anti")


def candidates(rows: DataFrame, key: str, single: list[str], several: list[str]) -> DataFrame:
    """Wide tags as rows (key, field, value, source, confidence); fields of several values are split."""
    def of(field: str):
        return lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"))

    pairs = F.concat(F.array(*[of(f)(F.col(f)) for f in single]), *[F.transform(split_values(F.coalesce(F.col(f), F.lit(""))), of(f)) for f in several])
    long = rows.select(key, F.explode(pairs).alias("p")).select(key, "p.*").where("value <> ''")
    return long.withColumns({"source": F.lit("tag_file"), "confidence": F.lit(0.7)})


def cue_ms(stamp: Column) -> Column:
    """Milliseconds of MM:SS:FF at 75 frames a second; null if out of range."""
    m, s, f = (F.regexp_extract(stamp, r"^(\d+):(\d\d):(\d\d)$", i) for i in (1, 2, 3))
    number = lambda x: F.try_to_number(F.when(x != "", x), F.lit("999999")).cast("long")
    ok = (number(s) < 60) & (number(f) < 75)
    return F.when(ok, number(m) * 60000 + number(s) * 1000 + F.floor((number(f) * 1000 + 37) / 75))


def cue_sheet(body: Column) -> Column:
    """(title, start_ms) of the tracks of a CUE sheet."""
    tracks = F.filter(F.split(body, r"(?m)^\s*TRACK\s"), lambda x, i: i > 0)
    return F.transform(tracks, lambda t: F.struct(F.regexp_extract(t, r'TITLE\s+"([^"]*)"', 1).alias("title"), cue_ms(F.regexp_extract(t, r"INDEX\s+01\s+(\d+:\d\d:\d\d)", 1)).alias("start_ms")))


def chapter_info(body: Column) -> Column:
    """The chapters in a catalogue answer; null where either level is absent."""
    shape = "content_metadata struct<chapter_info: struct<chapters: array<struct<title: string, start_offset_ms: bigint, length_ms: bigint>>>>"
    return F.from_json(body, shape)["content_metadata"]["chapter_info"]["chapters"]


def _stamp(ms: Column, mark: str) -> Column:
    ms = F.greatest(ms, F.lit(0)).cast("long")
    part = lambda of, to: F.floor(ms / of) % to
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", part(3_600_000, 1 << 30), part(60_000, 60), part(1000, 60), ms % 1000)


def _cues(rows: DataFrame, key: str, mark: str, numbered: bool) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("idx", "start_ms", "end_ms", F.replace(F.coalesce("title", F.lit("")), F.lit("\n"), F.lit(" ")).alias("title"))))
    line = lambda c, i: F.concat(
        *([(i + 1).cast("string"), F.lit("\n")] if numbered else []), _stamp(c["start_ms"], mark), F.lit(" --> "), _stamp(c["end_ms"], mark), F.lit("\n"), c["title"], F.lit("\n"))
    return rows.groupBy(key).agg(own.alias("c")).select(key, F.array_join(F.transform("c", line), "\n").alias("body"))


def srt(rows: DataFrame, key: str) -> DataFrame:
    """Subtitles of rows (key, idx, start_ms, end_ms, title), one file per key."""
    return _cues(rows, key, ",", True).withColumnRenamed("body", "srt")


def vtt(rows: DataFrame, key: str) -> DataFrame:
    return _cues(rows, key, ".", False).select(key, F.concat(F.lit("WEBVTT\n\n"), F.col("body")).alias("vtt"))


def m3u8(files: DataFrame, key: str) -> DataFrame:
    """A playlist per key of files (key, file_id, duration_ms), in order of file_id."""
    own = F.array_sort(F.collect_list(F.struct("file_id", "duration_ms")))
    secs = lambda f: F.when(f["duration_ms"].isNull(), F.lit(-1)).otherwise(F.greatest(F.floor(f["duration_ms"] / 1000), F.lit(0)))
    line = lambda f: F.concat(F.lit("#EXTINF:"), secs(f).cast("string"), F.lit(","), f["file_id"].cast("string"))
    return files.groupBy(key).agg(own.alias("f")).select(key, F.concat(F.lit("#EXTM3U\n"), F.array_join(F.transform("f", line), "\n")).alias("m3u8"))
