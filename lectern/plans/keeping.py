"""Queries over the library's records as its users keep them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import scalar as N
from lectern.operators import facets
from lectern.operators import keeping as K
from lectern.operators import state as S
from lectern.plans.catalog import _CAT, _rows
from lectern.plans.standins import frame, with_
from lectern.sources import formats

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


def _sql(spark, d, text, *tables):
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text.replace("VARCHAR(9)", "STRING").replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)"), **{t: _read(spark, d, t) for t in tables})


_FILES = "SELECT l_partkey * 100000000 + l_orderkey * 10 + l_linenumber AS file_id, l_partkey AS book_id, concat('/m/', CAST(l_partkey AS VARCHAR(9)), '/', CAST(l_linenumber AS VARCHAR(9)), '.m4b') AS file_path, CASE l_returnflag WHEN 'A' THEN 'm4b' ELSE 'mp3' END AS format, CAST(floor(l_extendedprice) AS BIGINT) AS size FROM lineitem"
_MEMBERS = "SELECT l_partkey AS book_id, l_suppkey AS narrator_id FROM lineitem"
_NARRATORS = "SELECT s_suppkey AS narrator_id, s_name AS name FROM supplier"
_VOICES = "SELECT s_suppkey AS narrator_id, concat('Voice ', CAST(s_nationkey AS VARCHAR(9))) AS alias, s_suppkey % 2 = 0 AS is_prime FROM supplier"


@query("book_list", _CAT + f""", f AS ({_FILES}), n AS ({_NARRATORS}), v AS ({_VOICES}), m AS (SELECT DISTINCT * FROM ({_MEMBERS})),
w AS (SELECT book_id, string_agg(DISTINCT coalesce((SELECT min(alias) FROM v WHERE v.narrator_id = n.narrator_id AND is_prime), n.name), ', ' ORDER BY coalesce((SELECT min(alias) FROM v WHERE v.narrator_id = n.narrator_id AND is_prime), n.name)) AS narrators FROM m JOIN n USING (narrator_id) GROUP BY 1)
SELECT cat.book_id, title, (SELECT arg_min(file_path, file_id) FROM f WHERE f.book_id = cat.book_id) AS file_path, author, narrators, series FROM cat LEFT JOIN w ON w.book_id = cat.book_id""".replace("string_agg(DISTINCT coalesce((SELECT min(alias) FROM v WHERE v.narrator_id = n.narrator_id AND is_prime), n.name), ', ' ORDER BY coalesce((SELECT min(alias) FROM v WHERE v.narrator_id = n.narrator_id AND is_prime), n.name))", "string_agg(DISTINCT shown, ', ' ORDER BY shown)").replace("FROM m JOIN n USING (narrator_id)", "FROM m JOIN (SELECT n.narrator_id, coalesce(min(alias) FILTER (is_prime), any_value(n.name)) AS shown FROM n LEFT JOIN v USING (narrator_id) GROUP BY 1) x USING (narrator_id)"))
def book_list(spark, d):
    out = K.listed_books(_rows(spark, d), _sql(spark, d, _FILES, "lineitem"), _sql(spark, d, _MEMBERS, "lineitem"), _sql(spark, d, _NARRATORS, "supplier"), _sql(spark, d, _VOICES, "supplier"))
    return out.select("book_id", "title", "file_path", "author", "narrators", "series")


_STAGES = "SELECT DISTINCT user_id AS book_id, event_type AS stage, CASE WHEN (user_id + length(event_type)) % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS status FROM events"
_CHAPTERS = "SELECT o_custkey AS book_id, o_orderstatus AS source, o_orderkey % 3 <> 0 AS is_winner FROM orders"
_CHARACTERS = "SELECT c_custkey AS book_id FROM customer WHERE c_nationkey % 2 = 0"


@query("book_page", with_("books") + f""", f AS ({_FILES}), p AS ({_STAGES}), c AS ({_CHAPTERS}), h AS ({_CHARACTERS}),
ff AS (SELECT book_id, string_agg(concat(CAST(file_id AS VARCHAR), ':', format, ':', CAST(size AS VARCHAR)), ',' ORDER BY file_id, format, size) AS files FROM f GROUP BY 1),
pp AS (SELECT book_id, string_agg(concat(stage, ':', status), ',' ORDER BY stage, status) AS stages FROM p GROUP BY 1),
cc AS (SELECT book_id, string_agg(concat(source, ':', CAST(n AS VARCHAR)), ',' ORDER BY source) AS chapters FROM (SELECT book_id, source, count(*) AS n FROM c WHERE is_winner GROUP BY 1, 2) GROUP BY 1)
SELECT b.book_id, title, files, stages, chapters, b.book_id IN (SELECT book_id FROM h) AS has_characters FROM books b LEFT JOIN ff USING (book_id) LEFT JOIN pp USING (book_id) LEFT JOIN cc USING (book_id)""")
def book_page(spark, d):
    out = K.details(frame(spark, d, "books").select("book_id", "title"), _sql(spark, d, _FILES, "lineitem"), _sql(spark, d, _STAGES, "events"), _sql(spark, d, _CHAPTERS, "orders"), _sql(spark, d, _CHARACTERS, "customer"))
    joined = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ",").alias(c)
    return out.select("book_id", "title", joined("files", "file_id", "format", "size"), joined("stages", "stage", "status"), joined("chapters", "source", "count"), "has_characters")


_PENDING = "SELECT o_orderkey AS pending_id, o_custkey AS book_id, concat('Name ', o_orderstatus) AS observed_alias, o_orderkey % 3 = 0 AS resolved FROM orders WHERE o_orderkey % 3 {}"
_CHOICES = "SELECT l_orderkey AS pending_id, l_suppkey AS id, concat('S', CAST(l_suppkey AS VARCHAR(9))) AS display, max(1 - l_discount) AS score FROM lineitem WHERE l_linenumber {} GROUP BY l_orderkey, l_suppkey"
_KINDS = {"author": ("IN (0, 1)", "> 0"), "narrator": ("IN (0, 2)", "> 2"), "series": (">= 0", "> 4")}


@query("pending_names", "WITH " + ", ".join(f"{k} AS (SELECT '{k}' AS kind, p.pending_id, book_id, observed_alias, id, display, score FROM ({_PENDING.format(a)}) p LEFT JOIN ({_CHOICES.format(b)}) c USING (pending_id) WHERE NOT resolved)" for k, (a, b) in _KINDS.items()) + """,
a AS (SELECT * FROM author UNION ALL SELECT * FROM narrator UNION ALL SELECT * FROM series)
SELECT kind, pending_id, book_id, observed_alias, CASE WHEN id IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY kind, pending_id ORDER BY score DESC NULLS LAST, id) AS INTEGER) END AS place, id, display, round(score, 6) AS score FROM a""")
def pending_names(spark, d):
    kinds = {k: (_sql(spark, d, _PENDING.format(a), "orders"), _sql(spark, d, _CHOICES.format(b), "lineitem")) for k, (a, b) in _KINDS.items()}
    return K.pending_all(kinds).withColumn("score", F.round("score", 6))


_OLD = "SELECT trim(lower(p_name)) AS title_norm, lower(p_brand) AS author_norm, concat('A', CAST(p_size AS VARCHAR(9))) AS asin, 'user' AS source, '2024-01-01' AS learned_at FROM part WHERE p_partkey % 4 = 0"
_LEARN = "SELECT concat(' ', upper(p_name), '  ') AS title, CASE WHEN p_size = 3 THEN ' ' ELSE p_brand END AS author, concat('A', CAST(p_size AS VARCHAR(9))) AS asin, 'edit' AS source, concat('2024-02-', CAST(10 + p_partkey % 15 AS VARCHAR(9))) AS learned_at FROM part"
_LEARNED = f"""WITH o AS ({_OLD}), n AS (SELECT trim(lower(title)) AS title_norm, trim(lower(author)) AS author_norm, asin, source, learned_at FROM ({_LEARN})),
l AS (SELECT * FROM o UNION ALL SELECT title_norm, author_norm, asin, 'edit', min(learned_at) FROM n WHERE author_norm <> '' AND (title_norm, author_norm, asin) NOT IN (SELECT (title_norm, author_norm, asin) FROM o) GROUP BY 1, 2, 3)"""


def _learned(spark, d):
    return K.captured(_sql(spark, d, _OLD, "part"), _sql(spark, d, _LEARN, "part"))


@query("learned_captured", _LEARNED + " SELECT title_norm, author_norm, asin, source, learned_at FROM l")
def learned_captured(spark, d):
    return _learned(spark, d)


@query("learned_page", _LEARNED + " SELECT title_norm, author_norm, asin, source, learned_at, (SELECT count(*) FROM l) AS total FROM l ORDER BY learned_at DESC, title_norm, author_norm, asin LIMIT 40 OFFSET 10")
def learned_page(spark, d):
    return K.learned_page(_learned(spark, d), 40, 10)


@query("learned_forgotten", _LEARNED + " SELECT title_norm, author_norm, asin FROM l WHERE NOT (asin = 'A7' OR author_norm = 'brand#2')")
def learned_forgotten(spark, d):
    rows = _learned(spark, d)
    return K.forgotten(rows, rows.where("asin = 'A7' OR author_norm = 'brand#2'").select("title_norm", "author_norm", "asin")).select("title_norm", "author_norm", "asin")


_ROOTS = "SELECT concat('/r/', CAST(c_custkey AS VARCHAR(9))) AS path, c_mktsegment AS label, c_custkey % 3 <> 0 AS is_active FROM customer"
_ASKED = "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN 'remove' ELSE 'add' END AS op, concat('/r/', CAST(o_custkey * 2 AS VARCHAR(9)), CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '' END) AS path, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS label FROM orders"


@query("library_roots", f"""WITH r AS ({_ROOTS}), a AS (SELECT request_id, op, rtrim(path, '/') AS path, label FROM ({_ASKED})),
l AS (SELECT path, arg_max(op, request_id) = 'add' AS s, arg_max(label, request_id) FILTER (op = 'add' AND label IS NOT NULL) AS n, bool_or(op = 'add') AS added FROM a GROUP BY 1)
SELECT coalesce(r.path, l.path) AS path, coalesce(l.n, r.label) AS label, coalesce(l.s, r.is_active) AS is_active FROM r FULL JOIN l ON l.path = r.path WHERE r.path IS NOT NULL OR added""")
def library_roots(spark, d):
    return K.roots_after(_sql(spark, d, _ROOTS, "customer"), _sql(spark, d, _ASKED, "orders"))


@query("restored_books", with_("books") + "SELECT book_id, CASE WHEN book_id % 34 <> 0 THEN deleted_at END AS deleted_at FROM books")
def restored_books(spark, d):
    books = frame(spark, d, "books")
    return K.restored(books, books.where("book_id % 34 = 0").select("book_id")).select("book_id", "deleted_at")


@query("purged_books", with_("books", "files") + ", g AS (SELECT book_id FROM books WHERE deleted_at IS NOT NULL AND book_id % 3 = 0) SELECT 'books' AS name, count(*) AS kept FROM books WHERE book_id NOT IN (SELECT book_id FROM g) UNION ALL SELECT 'files', count(*) FROM files WHERE book_id NOT IN (SELECT book_id FROM g)")
def purged_books(spark, d):
    books = frame(spark, d, "books")
    out = K.purged(books, {"files": frame(spark, d, "files")}, books.where("book_id % 3 = 0").select("book_id"))
    count = lambda n: out[n].agg(F.count("*").alias("kept")).select(F.lit(n).alias("name"), "kept")
    return count("books").unionByName(count("files"))


@query("stage_retries", f"WITH p AS ({_STAGES}) SELECT stage, (SELECT count(*) FROM p WHERE p.stage = a.stage AND status = 'failed') AS cleared FROM (SELECT DISTINCT event_type AS stage FROM events UNION SELECT 'none') a")
def stage_retries(spark, d):
    asked = _read(spark, d, "events").select(F.explode(F.array("event_type", F.lit("none"))).alias("stage"))
    return K.retried(_sql(spark, d, _STAGES, "events"), asked)[1]


_T = {
    "journal": ("SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'pending' ELSE 'done' END AS progress, ts AS created_at FROM events", "events"),
    "companions": ("SELECT CASE WHEN page_id % 5 <> 0 THEN page_id END AS book_id FROM pages", "pages"),
    "winners": ("SELECT l_orderkey AS book_id, l_returnflag AS field FROM lineitem WHERE l_discount > 0.08", "lineitem"),
    "stages": ("SELECT event_type AS stage FROM events", "events"),
    "collections": ("SELECT c_custkey AS collection_id, CASE WHEN c_nationkey <> 3 THEN concat('N', CAST(c_custkey % 50 AS VARCHAR(9))) END AS audible_id FROM customer", "customer"),
    "members": ("SELECT o_custkey AS collection_id, o_orderkey % 300 AS book_id FROM orders WHERE o_orderkey % 2 = 0", "orders"),
}


@query("library_checks", with_("books") + ", " + ", ".join(f"t_{n} AS ({s})" for n, (s, _) in _T.items()) + """, r AS (
SELECT 'pending operations' AS check_name, 'warn' AS bad, (SELECT count(*) FROM t_journal WHERE progress = 'pending') AS n
UNION ALL SELECT 'failed operations', 'warn', (SELECT count(*) FROM t_journal WHERE progress = 'failed' AND created_at >= TIMESTAMP '2024-02-01' - INTERVAL 7 DAY)
UNION ALL SELECT 'unpaired companions', 'warn', (SELECT count(*) FROM t_companions WHERE book_id IS NULL)
UNION ALL SELECT 'two winners of a field', 'fail', (SELECT count(*) FROM (SELECT 1 FROM t_winners GROUP BY book_id, field HAVING count(*) > 1))
UNION ALL SELECT 'unknown stages', 'warn', (SELECT count(DISTINCT stage) FROM t_stages WHERE stage NOT IN ('view', 'click', 'error'))
UNION ALL SELECT 'empty collections', 'warn', (SELECT count(*) FROM t_collections WHERE collection_id NOT IN (SELECT collection_id FROM t_members WHERE book_id IN (SELECT book_id FROM books WHERE deleted_at IS NULL)))
UNION ALL SELECT 'members that are deleted', 'warn', (SELECT count(*) FROM t_members WHERE book_id IN (SELECT book_id FROM books WHERE deleted_at IS NOT NULL))
UNION ALL SELECT 'collections of one number', 'fail', (SELECT count(*) FROM (SELECT 1 FROM t_collections WHERE audible_id IS NOT NULL GROUP BY audible_id HAVING count(*) > 1)))
SELECT check_name, CASE WHEN n = 0 THEN 'ok' ELSE bad END AS status, n FROM r""")
def library_checks(spark, d):
    tables = {n: _sql(spark, d, s, t) for n, (s, t) in _T.items()} | {"books": frame(spark, d, "books")}
    return K.checks(tables, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), ["view", "click", "error"])


_SECS = "CASE WHEN o_orderkey % 50 = 0 THEN 0 WHEN o_orderkey % 50 <> 1 THEN o_orderkey * 86399 - 40000000 END"
_SHORT = "['ene.', 'feb.', 'mar.', 'abr.', 'may.', 'jun.', 'jul.', 'ago.', 'sept.', 'oct.', 'nov.', 'dic.']"


@query("date_texts", f"""WITH t AS (SELECT o_orderkey, CAST({_SECS} AS BIGINT) AS s FROM orders), d AS (SELECT o_orderkey, s, TIMESTAMP '1970-01-01' + to_seconds(s) AS t FROM t)
SELECT o_orderkey, CASE WHEN coalesce(s, 0) = 0 THEN '—' ELSE strftime(t, '%m/%d/%Y') END AS en_short, CASE WHEN coalesce(s, 0) = 0 THEN '—' ELSE strftime(t, '%d.%m.%Y %H:%M') END AS de_short,
CASE WHEN coalesce(s, 0) = 0 THEN '—' ELSE concat(CAST(day(t) AS VARCHAR), ' ', {_SHORT}[month(t)], ' ', CAST(year(t) AS VARCHAR)) END AS es_medium, CASE WHEN coalesce(s, 0) = 0 THEN '—' ELSE strftime(t, '%Y-%m-%d') END AS other_short,
CASE WHEN coalesce(s, 0) = 0 THEN '—' ELSE concat(monthname(t)[1:3], ' ', CAST(day(t) AS VARCHAR), ', ', CAST(year(t) AS VARCHAR), ' ', CAST((hour(t) + 11) % 12 + 1 AS VARCHAR), ':', strftime(t, '%M'), CASE WHEN hour(t) < 12 THEN ' AM' ELSE ' PM' END) END AS en_medium,
CASE WHEN coalesce(s, 0) = 0 THEN '—' ELSE concat(CAST(day(t) AS VARCHAR), ' ', monthname(t), ' ', CAST(year(t) AS VARCHAR)) END AS other_long FROM d""")
def date_texts(spark, d):
    s = F.expr(f"CAST({_SECS} AS BIGINT)")
    return _read(spark, d, "orders").select(
        "o_orderkey", N.date_text(s, "en-US", "short").alias("en_short"), N.datetime_text(s, "de", "short").alias("de_short"), N.date_text(s, "es", "medium").alias("es_medium"),
        N.date_text(s, "pl", "short").alias("other_short"), N.datetime_text(s, "en", "medium").alias("en_medium"), N.date_text(s, "pl").alias("other_long"))


_CODE = "CASE WHEN o_orderkey % 9 = 0 THEN 128512 + o_orderkey % 60 ELSE 161 + o_orderkey % 9000 END"


@query("decoded_entities", f"""SELECT o_orderkey, concat('a ', chr(CAST({_CODE} AS INTEGER)), ' < "', '&', 'lt; &x; &#xD800; &; ', chr(CAST({_CODE} AS INTEGER)), '; & b &#99999999; ', chr(160), '>') AS text FROM orders""")
def decoded_entities(spark, d):
    code = F.expr(f"CAST({_CODE} AS BIGINT)")
    raw = F.concat(F.lit("a &#"), code.cast("string"), F.lit("; &lt; &quot;&amp;lt; &x; &#xD800; &; &#x"), F.lower(F.hex(code)), F.lit(";; & b &#99999999; &nbsp;&gt;"))
    return _read(spark, d, "orders").select("o_orderkey", N.decoded(raw).alias("text"))


_ENTITIES = "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN concat(CASE WHEN s_nationkey % 4 = 0 THEN 'z' ELSE 'A' END, s_name) END AS name_sort, CAST(s_nationkey AS BIGINT) AS book_count FROM supplier"


@query("entities_by_sort_name", f"SELECT id, name FROM ({_ENTITIES}) ORDER BY lower(coalesce(name_sort, name)) DESC, id LIMIT 60")
def entities_by_sort_name(spark, d):
    return K.entity_order(_sql(spark, d, _ENTITIES, "supplier"), "name_sort", True).limit(60).select("id", "name")


@query("web_subtitles", with_("segments") + """SELECT book_id, concat('WEBVTT', chr(10), chr(10), string_agg(concat(format('{:02d}:{:02d}:{:02d}.000 --> {:02d}:{:02d}:{:02d}.000', idx * 5 // 3600, idx * 5 // 60 % 60, idx * 5 % 60, (idx + 1) * 5 // 3600, (idx + 1) * 5 // 60 % 60, (idx + 1) * 5 % 60), chr(10), replace(said, chr(10), ' '), chr(10)), chr(10) ORDER BY idx)) AS vtt FROM segments GROUP BY book_id""")
def web_subtitles(spark, d):
    return formats.vtt(frame(spark, d, "segments").selectExpr("book_id", "idx", "idx * 5000 AS start_ms", "(idx + 1) * 5000 AS end_ms", "said AS title"), "book_id")


_INFO = """CASE p_size % 4 WHEN 0 THEN '{"content_metadata":{}}' WHEN 1 THEN '{"other":1}' ELSE concat('{"content_metadata":{"chapter_info":{"chapters":[{"title":"', p_name, '","start_offset_ms":0,"length_ms":', CAST(p_size AS VARCHAR(9)), '},{"title":"End","start_offset_ms":', CAST(p_size AS VARCHAR(9)), ',"length_ms":5}]}}}') END"""


@query("chapter_infos", "SELECT p_partkey, p_name AS title, 0::BIGINT AS start_ms, CAST(p_size AS BIGINT) AS end_ms FROM part WHERE p_size % 4 > 1 UNION ALL SELECT p_partkey, 'End', p_size, p_size + 5 FROM part WHERE p_size % 4 > 1")
def chapter_infos(spark, d):
    rows = _read(spark, d, "part").selectExpr("p_partkey", f"{_INFO.replace('VARCHAR(9)', 'STRING')} AS body").select("p_partkey", F.explode(formats.chapter_info(F.col("body"))).alias("c"))
    return rows.select("p_partkey", "c.title", F.col("c.start_offset_ms").alias("start_ms"), (F.col("c.start_offset_ms") + F.col("c.length_ms")).alias("end_ms"))


_DIRS = "SELECT o_orderkey AS book_id, concat('/m', CASE o_custkey % 4 WHEN 0 THEN '' WHEN 3 THEN concat('/set', CAST(o_custkey % 50 AS VARCHAR(9)), '/inner') ELSE concat('/set', CAST(o_custkey % 50 AS VARCHAR(9))) END, '/', CAST(o_orderkey AS VARCHAR(9))) AS dir FROM orders"


@query("box_sets", f"""WITH b AS ({_DIRS}), g AS (SELECT regexp_extract(dir, '^(.*)/[^/]*$', 1) AS folder, count(*) AS books FROM b GROUP BY 1 HAVING count(*) > 1)
SELECT folder, books FROM g WHERE folder <> '/m' AND folder NOT IN (SELECT regexp_extract(folder, '^(.*)/[^/]*$', 1) FROM g) AND folder NOT IN (SELECT concat('/m/set', CAST(c_nationkey AS VARCHAR)) FROM customer WHERE c_nationkey % 5 = 2)""")
def box_sets(spark, d):
    existing = _sql(spark, d, "SELECT concat('/m/set', CAST(c_nationkey AS VARCHAR(9))) AS folder FROM customer WHERE c_nationkey % 5 = 2", "customer").distinct()
    return formats.box_sets(_sql(spark, d, _DIRS, "orders"), "/m", existing)


_HEARD = "SELECT event_id AS row_id, user_id AS file_id, event_type AS kind, epoch_us(ts) // 1000 AS start_ms FROM events"


@query("corroborated_hits", f"""WITH s AS (SELECT * FROM ({_HEARD}) WHERE row_id % 3 <> 0), p AS (SELECT file_id, kind, start_ms // 1000000 * 1000000 + 1500 AS a FROM ({_HEARD}))
SELECT row_id, start_ms // 500 AS place, CASE WHEN hit THEN 'fingerprint_and_transcript' ELSE 'transcript_only' END AS method, CASE WHEN hit THEN 0.75 ELSE 0.55 END::DOUBLE AS confidence
FROM (SELECT *, EXISTS (SELECT 1 FROM p WHERE p.file_id = s.file_id AND p.kind = s.kind AND abs(s.start_ms // 500 - p.a // 500) <= 2000) AS hit FROM s)""")
def corroborated_hits(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = _read(spark, d, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("file_id"), F.col("event_type").alias("kind"), ms.alias("ms"))
    said = e.where("row_id % 3 <> 0").select("row_id", "file_id", "kind", F.floor(F.col("ms") / 500).alias("start_ms"), F.lit("transcript_only").alias("method"), F.lit(0.55).alias("confidence"))
    prints = e.select("file_id", "kind", F.floor((F.floor(F.col("ms") / 1000000) * 1000000 + 1500) / 500).alias("start_ms"))
    return K.corroborated(said, prints).select("row_id", F.col("start_ms").alias("place"), "method", "confidence")


_LOGOS = "SELECT o_custkey AS book_id, CASE o_orderkey % 7 WHEN 0 THEN 'applied' WHEN 1 THEN 're_detected' WHEN 2 THEN 'candidate' WHEN 3 THEN 'odd' ELSE 'rejected' END AS status FROM orders WHERE o_custkey % 3 = 0 OR o_orderkey % 7 > 2"
_WAS = "SELECT c_custkey AS book_id, CASE c_nationkey % 3 WHEN 0 THEN 'stripped' WHEN 1 THEN 'none' ELSE 'applied' END AS audiologo_status FROM customer"


@query("logo_states", f"""WITH m AS ({_LOGOS}), n AS (SELECT book_id, count_if(status = 'applied') AS a, count_if(status IN ('candidate', 're_detected')) AS c, count_if(status = 'rejected') AS r FROM m GROUP BY 1)
SELECT b.book_id, CASE WHEN n.book_id IS NULL THEN CASE WHEN audiologo_status IN ('stripped', 'none') THEN audiologo_status ELSE 'unknown' END WHEN a > 0 THEN 'applied' WHEN c > 0 THEN 'detected' WHEN r > 0 THEN 'rejected' ELSE 'unknown' END AS audiologo_status FROM ({_WAS}) b LEFT JOIN n ON n.book_id = b.book_id""")
def logo_states(spark, d):
    return K.logo_states(_sql(spark, d, _WAS, "customer"), _sql(spark, d, _LOGOS, "orders"))


@query("stage_reset_parts", """WITH a AS (SELECT DISTINCT user_id AS b, event_id % 97 AS s FROM events WHERE event_type = 'error')
SELECT 'progress' AS part, count(*) AS kept FROM events WHERE (user_id, event_id % 97) NOT IN (SELECT (b, s) FROM a) UNION ALL SELECT 'caches', count(*) FROM orders WHERE (o_custkey, o_orderkey % 97) NOT IN (SELECT (b, s) FROM a) UNION ALL SELECT 'provenance', count(*) FROM lineitem WHERE (l_suppkey, l_orderkey % 97) NOT IN (SELECT (b, s) FROM a)""")
def stage_reset_parts(spark, d):
    of = lambda t, book, stage: _read(spark, d, t).selectExpr(f"{book} AS book_id", f"{stage} % 97 AS stage")
    asked = _read(spark, d, "events").where("event_type = 'error'").selectExpr("user_id AS book_id", "event_id % 97 AS stage")
    out = S.reset(of("events", "user_id", "event_id"), of("orders", "o_custkey", "o_orderkey"), of("lineitem", "l_suppkey", "l_orderkey"), asked)
    parts = [rows.agg(F.count("*").alias("kept")).select(F.lit(n).alias("part"), "kept") for n, rows in zip(("progress", "caches", "provenance"), out, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("length_buckets", with_("books") + "SELECT book_id, CASE WHEN duration_ms IS NULL THEN 'unknown' WHEN duration_ms < 14400000 THEN '<4h' WHEN duration_ms < 28800000 THEN '4-8h' WHEN duration_ms < 54000000 THEN '8-15h' WHEN duration_ms < 90000000 THEN '15-25h' ELSE '25h+' END AS bucket FROM books")
def length_buckets(spark, d):
    return frame(spark, d, "books").select("book_id", facets.length_bucket(F.col("duration_ms")).alias("bucket"))


#: Entities, their books and their aliases, of each kind.
_DETAILS = {
    "author": ("SELECT s_suppkey AS id, s_name AS name FROM supplier", "SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS id, p_partkey AS book_id FROM part", "SELECT c_nationkey AS id, c_custkey AS alias_id, c_mktsegment AS alias FROM customer"),
    "narrator": ("SELECT s_suppkey AS id, s_name AS name FROM supplier", "SELECT l_suppkey AS id, l_partkey AS book_id FROM lineitem", "SELECT c_custkey % 40 AS id, -c_custkey AS alias_id, c_name AS alias FROM customer"),
    "series": ("SELECT p_partkey AS id, p_name AS name FROM part", "SELECT p_partkey - p_partkey % 7 AS id, p_partkey AS book_id FROM part", "SELECT p_partkey AS id, p_size AS alias_id, p_brand AS alias FROM part"),
    "publisher": ("SELECT n_nationkey AS id, n_name AS name FROM nation", "SELECT p_partkey % 27 AS id, p_partkey AS book_id FROM part", "SELECT s_nationkey AS id, s_suppkey AS alias_id, s_name AS alias FROM supplier"),
    "collection": ("SELECT c_custkey AS id, c_name AS name FROM customer", "SELECT o_custkey AS id, o_orderkey % 500 AS book_id FROM orders", "SELECT c_custkey AS id, c_custkey AS alias_id, c_mktsegment AS alias FROM customer"),
}


@query("entity_details", " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(e.id AS BIGINT) AS id, name, (SELECT count(DISTINCT book_id) FROM ({m}) m WHERE m.id = e.id) AS book_count, coalesce((SELECT string_agg(alias, '; ' ORDER BY alias_id, alias) FROM ({a}) a WHERE a.id = e.id), '') AS aliases FROM ({e}) e" for k, (e, m, a) in _DETAILS.items()))
def entity_details(spark, d):
    out = None
    for kind, parts in _DETAILS.items():
        rows = K.entity_details(kind, *(_sql(spark, d, p, p.rsplit(" ", 1)[1]) for p in parts)).withColumns({"id": F.col("id").cast("long"), "aliases": F.array_join("aliases", "; ")})
        out = rows if out is None else out.unionByName(rows)
    return out


_HAS = "SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS description, CAST(NULL AS VARCHAR(9)) AS cover FROM customer WHERE c_custkey % 3 = 0"
_WANT = "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 10 = 0 THEN '  ' WHEN o_orderkey % 4 = 1 THEN concat(' cUSTOMER#', lpad(CAST(o_custkey AS VARCHAR(9)), 9, '0'), ' ') ELSE concat('New ', CAST(o_orderkey % 700 AS VARCHAR(9))) END AS name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(o_orderstatus, ' ') END AS description, CASE WHEN o_orderkey % 5 = 0 THEN 'c.jpg' END AS cover FROM orders"
_NEW = f"""WITH h AS ({_HAS}), w AS (SELECT request_id, nullif(trim(name), '') AS name, nullif(trim(description), '') AS description, nullif(trim(cover), '') AS cover FROM ({_WANT})),
n AS (SELECT * FROM w WHERE name IS NOT NULL AND lower(name) NOT IN (SELECT lower(name) FROM h) QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY request_id) = 1)"""


def _created(spark, d):
    return K.created(_sql(spark, d, _HAS, "customer"), _sql(spark, d, _WANT, "orders"), ("description", "cover"))


@query("collections_created", _NEW + " SELECT * FROM h UNION ALL SELECT name, description, cover FROM n")
def collections_created(spark, d):
    return _created(spark, d)[0]


@query("collections_logged", _NEW + " SELECT request_id, 'name' AS field, name AS after FROM n UNION ALL SELECT request_id, 'description', description FROM n WHERE description IS NOT NULL UNION ALL SELECT request_id, 'cover', cover FROM n WHERE cover IS NOT NULL")
def collections_logged(spark, d):
    return _created(spark, d)[1]


@query("collections_refused", _NEW + " SELECT request_id FROM w WHERE request_id NOT IN (SELECT request_id FROM n)")
def collections_refused(spark, d):
    return _created(spark, d)[2]


_ROWS = "SELECT l_orderkey AS book_id, l_returnflag AS field, CASE WHEN l_linenumber <> 3 THEN l_linestatus END AS value, CASE l_suppkey % 3 WHEN 0 THEN 'cue' WHEN 1 THEN 'tag' ELSE 'web' END AS source, max(1 - l_discount) AS confidence FROM lineitem WHERE {} GROUP BY ALL"


@query("candidates_added", f"WITH o AS ({_ROWS.format('l_discount < 0.03')}), n AS ({_ROWS.format('l_discount >= 0.02')}) SELECT book_id, field, value, source, round(confidence, 6) AS confidence FROM (SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.book_id = n.book_id AND o.field = n.field AND o.value IS NOT DISTINCT FROM n.value AND o.source = n.source))")
def candidates_added(spark, d):
    old, new = (_sql(spark, d, _ROWS.format(f"l_discount {c}"), "lineitem") for c in ("< 0.03", ">= 0.02"))
    return K.added_candidates(old, new).withColumn("confidence", F.round("confidence", 6))


_TOLD = "SELECT doc_id AS book_id, CASE WHEN doc_id % 6 = 0 THEN ' ' WHEN doc_id % 6 = 1 THEN NULL ELSE source END AS description, CASE WHEN doc_id % 5 = 0 THEN 'xx' END AS description_lang FROM documents"


@query("descriptions_told", f"SELECT t.book_id, coalesce(description_lang, CASE WHEN trim(coalesce(description, '')) <> '' AND t.book_id % 4 <> 0 THEN lang END) AS description_lang FROM ({_TOLD}) t JOIN documents ON doc_id = t.book_id")
def descriptions_told(spark, d):
    found = _read(spark, d, "documents").where("doc_id % 4 <> 0").selectExpr("doc_id AS book_id", "lang")
    return K.described(_sql(spark, d, _TOLD, "documents"), found).select("book_id", "description_lang")


_MODELS = "SELECT concat(CASE n_nationkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'DE' WHEN 2 THEN 'fr' ELSE 'pt' END, '-', CAST(n_regionkey AS VARCHAR(9))) AS locale, n_nationkey % 3 = 0 AS installed, n_nationkey AS requested_at FROM nation"
_HELD = "SELECT user_id AS book_id, CASE event_type WHEN 'error' THEN 'blocked' ELSE 'done' END AS status FROM events"


@query("pending_installs", with_("books") + f", m AS ({_MODELS}), p AS ({_HELD}) SELECT locale, min(requested_at) AS requested_at, (SELECT count(*) FROM books WHERE deleted_at IS NULL AND lower(language) = lower(split_part(locale, '-', 1)) AND book_id IN (SELECT book_id FROM p WHERE status = 'blocked')) AS blocked FROM m WHERE NOT installed GROUP BY locale")
def pending_installs(spark, d):
    return K.pending_installs(_sql(spark, d, _MODELS, "nation"), frame(spark, d, "books"), _sql(spark, d, _HELD, "events"))
