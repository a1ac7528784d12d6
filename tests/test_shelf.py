"""Stated cases of items, reviews, archives and companion files."""

import json

from pyspark.sql import functions as F

from lectern.operators import shelf
from lectern.sources.companions import companion_files, companion_format

HEADS = [
    (b"%PDF-1.4", "pdf"), (b"Rar!\x1a\x07\x00", "cbr"), (b"7z\xbc\xaf\x27\x1c", "cb7"), (b"\xeaDRMION!", "kfx"), (b"ITOLITLS", "lit"), (b"\0" * 60 + b"BOOKMOBI", "mobi"),
    (b"\0" * 257 + b"ustar\0", "cbt"), (b"\0" * 257 + b"ustar", None), (b"PK\x03\x04" + b"\0" * 26 + b"mimetypeapplication/epub+zip", "epub"), (b"PK\x03\x04" + b"\0" * 300 + b"mimetypeapplication/epub+zip", "cbz"),
    (b"<?xml?>" + b" " * 400 + b"<FictionBook>", "fb2"), (b"<?xml?>" + b" " * 600 + b"<FictionBook>", None), (b"AT&TFORM\0\0\0\0DJVU", "djvu"), (b"AT&TFORM", None), (b"", None), (None, None),
]


def test_companion_format(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HEADS)], "i int, head binary")
    got = dict(rows.select("i", companion_format(F.col("head"))).collect())
    assert [got[i] for i in range(len(HEADS))] == [want for _, want in HEADS]


def test_companion_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name, body in {"a.PDF": b"%PDF-1", "b/c.epub": b"PK\x03\x04x", "b/d.pdf": b"no", "e.txt": b"%PDF", "f.azw3": b"\0" * 60 + b"BOOKMOBI"}.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.format) for r in companion_files(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": (6, "pdf"), "c.epub": (5, "cbz"), "f.azw3": (68, "mobi")}


def test_review_list(spark):
    matches = spark.createDataFrame([(1, 10, 5, "intro", 0.9, "candidate"), (2, 10, None, "outro", 0.5, "candidate"), (3, 10, 5, "intro", 0.9, "applied"), (4, 99, 5, "intro", 0.9, "candidate"), (5, 11, 6, None, None, "candidate")],
                                    "row_id long, file_id long, signature_id long, kind string, confidence double, status string")
    files = spark.createDataFrame([(10, 1), (11, 2), (None, 1)], "file_id long, book_id long")
    books = spark.createDataFrame([(1, "One"), (2, None)], "book_id long, title string")
    got = shelf.review_list(matches, files, books, spark.createDataFrame([(5, "Jingle")], "signature_id long, name string")).collect()
    assert sorted((r.row_id, r.book_id, r.signature) for r in got) == [(1, 1, "Jingle"), (2, 1, None), (5, 2, None)]


def test_player_items(spark):
    books = spark.createDataFrame([(1, "One", None, None, 5, 7, 61_500, "2001-02-03"), (2, "Two", "sub", "en", None, None, -1, None)],
                                  "book_id long, title string, subtitle string, language string, author_id long, publisher_id long, duration_ms long, release_date string")
    names = lambda key, rows: spark.createDataFrame(rows, f"{key} long, name string")
    files = spark.createDataFrame([(1, 12, "/x/b.mp3", None, "MP3", 1500, True), (1, 11, "/x/a.zzz", 9, None, None, True), (2, 13, "/y", 1, "mp3", 1, False)],
                                  "book_id long, file_id long, path string, size long, format string, duration_ms long, is_active boolean")
    out = shelf.player_items(books, names("author_id", [(5, "Ann")]), names("publisher_id", []), names("book_id", [(1, "Zoe"), (1, "Bo")]), files, "main")
    got = {r.book_id: json.loads(r.item) for r in out.collect()}
    assert got[1] == {"id": "1", "libraryId": "main", "mediaType": "book", "media": {
        "metadata": {"title": "One", "authorName": "Ann", "narratorName": "Bo, Zoe", "publishedYear": "2001"}, "duration": 61.5, "coverPath": "/api/items/1/cover", "audioFiles": [
            {"ino": "11", "metadata": {"filename": "a.zzz", "path": "/x/a.zzz", "size": 9}, "duration": 0.0, "mimeType": "application/octet-stream"},
            {"ino": "12", "metadata": {"filename": "b.mp3", "path": "/x/b.mp3"}, "duration": 1.5, "mimeType": "audio/mpeg"}]}}
    assert got[2]["media"] == {"metadata": {"title": "Two", "subtitle": "sub", "language": "en"}, "duration": 0.0, "audioFiles": []}


def test_archive_ledger(spark):
    kept = spark.createDataFrame([(1, "/a", "h1", 5, "then"), (2, "/b", "h2", 6, "then")], "archive_id long, source_path string, source_hash string, bytes_in long, extracted_at string")
    runs = spark.createDataFrame([(1, "/a", "h3", 7), (2, "/a", "h4", None), (3, "/c", "h5", 8)], "run_id long, source_path string, source_hash string, bytes_in long")
    got = sorted(map(tuple, shelf.archive_ledger(kept, runs, F.lit("now")).collect()), key=lambda r: r[1])
    assert got == [(1, "/a", "h4", None, "now"), (2, "/b", "h2", 6, "then"), (None, "/c", "h5", 8, "now")]
    assert sorted(map(tuple, shelf.archive_ledger(kept, runs.limit(0), F.lit("now")).collect())) == sorted(map(tuple, kept.collect()))
