"""Items, reviews, archives and companions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import shelf as S
from lectern.plans.standins import frame, with_
from lectern.sources.companions import companion_format

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_MATCHES = """l_orderkey * 10 + l_linenumber AS row_id, l_partkey * 100000000 + l_orderkey * 10 + l_linenumber AS file_id, CASE l_returnflag WHEN 'R' THEN 'outro' ELSE 'intro' END AS kind,
l_discount AS confidence, CASE l_linestatus WHEN 'O' THEN 'candidate' ELSE 'applied' END AS status, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_suppkey END AS signature_id"""


@query("review_list", with_("files", "books") + f""", m AS (SELECT {_MATCHES} FROM lineitem)
SELECT f.book_id, b.title, m.file_id, m.row_id, m.kind, m.confidence, m.signature_id, s.s_name AS signature FROM m JOIN files f ON f.file_id = m.file_id JOIN books b ON b.book_id = f.book_id
LEFT JOIN supplier s ON s.s_suppkey = m.signature_id WHERE m.status = 'candidate'""")
def review_list(spark, d):
    matches = _read(spark, d, "lineitem").selectExpr(*[x.strip() for x in _MATCHES.split(",")])
    signatures = _read(spark, d, "supplier").selectExpr("s_suppkey AS signature_id", "s_name AS name")
    return S.review_list(matches, frame(spark, d, "files"), frame(spark, d, "books"), signatures)


@query("player_items", with_("books", "authors", "publishers", "files", "book_narrator") + """, n AS (SELECT book_id, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT DISTINCT book_id, narrator_id FROM book_narrator) JOIN authors ON author_id = narrator_id GROUP BY book_id),
f AS (SELECT book_id, list(json_object('ino', CAST(file_id AS VARCHAR), 'metadata', json_object('filename', concat(CAST(file_id AS VARCHAR), '.x'), 'path', concat('/lib/', CAST(book_id AS VARCHAR), '/', CAST(file_id AS VARCHAR), '.x'), 'size', size),
  'duration', coalesce(duration_ms, 0) / 1000.0::DOUBLE, 'mimeType', CASE format WHEN 'M4B' THEN 'audio/mp4' WHEN 'mp3' THEN 'audio/mpeg' ELSE 'audio/flac' END) ORDER BY file_id, size, coalesce(duration_ms, 0), CASE format WHEN 'M4B' THEN 2 WHEN 'mp3' THEN 3 ELSE 1 END) AS files FROM files WHERE is_active GROUP BY book_id)
SELECT b.book_id, CAST(json_merge_patch('{}', json_object('id', CAST(b.book_id AS VARCHAR), 'libraryId', 'default', 'mediaType', 'book', 'media', json_object('metadata',
  json_object('title', title, 'subtitle', subtitle, 'authorName', a.name, 'narratorName', n.names, 'publisher', p.name, 'language', language, 'publishedYear', string_split(release_date, '-')[1]),
  'duration', coalesce(duration_ms, 0) / 1000.0::DOUBLE, 'audioFiles', coalesce(f.files, []), 'coverPath', CASE WHEN f.files IS NOT NULL THEN concat('/api/items/', CAST(b.book_id AS VARCHAR), '/cover') END))) AS VARCHAR) AS item
FROM books b LEFT JOIN authors a ON a.author_id = b.author_id LEFT JOIN publishers p ON p.publisher_id = b.publisher_id LEFT JOIN n ON n.book_id = b.book_id LEFT JOIN f ON f.book_id = b.book_id""")
def player_items(spark, d):
    files = frame(spark, d, "files").withColumn("path", F.format_string("/lib/%d/%d.x", "book_id", "file_id"))
    names = frame(spark, d, "authors").select(F.col("author_id").alias("narrator_id"), "name")
    narrators = frame(spark, d, "book_narrator").distinct().join(names, "narrator_id")
    return S.player_items(frame(spark, d, "books"), frame(spark, d, "authors"), frame(spark, d, "publishers"), narrators, files)


_RUN = ["l_orderkey * 10 + l_linenumber AS run_id", "concat('/in/', CAST(l_partkey AS VARCHAR(40)), CASE WHEN l_linenumber = 7 THEN '.new' ELSE '' END) AS source_path", "concat(l_returnflag, CAST(l_suppkey AS VARCHAR(40))) AS source_hash", "CAST(l_quantity AS BIGINT) AS bytes_in"]
_KEPT = ["p_partkey AS archive_id", "concat('/in/', CAST(p_partkey AS VARCHAR(40))) AS source_path", "p_name AS source_hash", "CAST(p_size AS BIGINT) AS bytes_in", "'1990-01-01' AS extracted_at"]


@query("archive_ledger", f"""WITH k AS (SELECT {', '.join(_KEPT)} FROM part), r AS (SELECT {', '.join(_RUN)} FROM lineitem), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY run_id DESC, source_hash DESC, bytes_in DESC) = 1)
SELECT archive_id, coalesce(k.source_path, l.source_path) AS source_path, coalesce(l.source_hash, k.source_hash) AS source_hash, coalesce(l.bytes_in, k.bytes_in) AS bytes_in,
  CASE WHEN run_id IS NULL THEN extracted_at ELSE '1999-01-01' END AS extracted_at FROM k FULL JOIN l ON l.source_path = k.source_path""")
def archive_ledger(spark, d):
    spelt = lambda columns: [c.replace("VARCHAR(40)", "STRING") for c in columns]
    kept, runs = _read(spark, d, "part").selectExpr(*spelt(_KEPT)), _read(spark, d, "lineitem").selectExpr(*spelt(_RUN))
    return S.archive_ledger(kept, runs, F.lit("1999-01-01"))


_HEADS = """CASE doc_id % 10 WHEN 0 THEN concat('%PDF-1.7 ', text) WHEN 1 THEN concat('ITOLITLS', text) WHEN 2 THEN concat(repeat('x', 60), 'BOOKMOBI', text) WHEN 3 THEN concat(repeat('x', 257), 'ustar0', text)
WHEN 4 THEN concat('PK', char(3), char(4), repeat('.', 26), 'mimetypeapplication/epub+zip', text) WHEN 5 THEN concat('PK', char(3), char(4), text) WHEN 6 THEN concat('<?xml version="1.0"?> <FictionBook>', text)
WHEN 7 THEN concat('AT&TFORM....DJVU', text) WHEN 8 THEN concat(' %PDF', text) ELSE '' END"""


@query("companion_formats", """SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE CASE doc_id % 10 WHEN 0 THEN 'pdf' WHEN 1 THEN 'lit' WHEN 2 THEN 'mobi' WHEN 3 THEN 'cbt' WHEN 4 THEN 'epub' WHEN 5 THEN 'cbz' WHEN 6 THEN 'fb2' WHEN 7 THEN 'djvu' END END AS format FROM documents""")
def companion_formats(spark, d):
    return _read(spark, d, "documents").select("doc_id", companion_format(F.expr(_HEADS).cast("binary")).alias("format"))
