"""Search, text and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import scalar as N
from lectern.operators import search as X
from lectern.operators import state as S
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


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


_TOK = "list_filter(string_split_regex(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_DOCS = f"WITH d AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents) "


@query("postings", _DOCS + "SELECT doc_id, term, count(*) AS tf, CAST(any_value(length) AS BIGINT) AS length FROM (SELECT doc_id, unnest(t) AS term, len(t) AS length FROM d) GROUP BY doc_id, term")
def postings(spark, d):
    return X.postings(_docs(spark, d), "doc_id", "text")


@query("search_fuzzy", "SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'icens') OR contains(lower(coalesce(source, '')), 'icens')")
def search_fuzzy(spark, d):
    return X.substring_match(_docs(spark, d), ["text", "source"], "ICENS").select("doc_id")


@query("search_entities", with_("books", "authors") + "SELECT a.author_id, name, (SELECT count(*) FROM books b WHERE b.author_id = a.author_id) AS book_count FROM authors a WHERE name ILIKE '%0001%'")
def search_entities(spark, d):
    from lectern.operators.catalog import entity_list

    hits = X.substring_match(frame(spark, d, "authors"), ["name"], "0001")
    return entity_list(hits, frame(spark, d, "books").select("author_id"), "author_id")


@query("sanitised_query", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}''-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM documents")
def sanitised_query(spark, d):
    return _docs(spark, d).select("doc_id", X.sanitised(F.col("text")).alias("q"))


@query("sanitised_text", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}''-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM documents")
def sanitised_text(spark, d):
    return _docs(spark, d).select("doc_id", X.sanitised(F.col("text")).alias("q"))


@query("learned_lookup", with_("books") + """, l AS (SELECT book_id AS id, concat('  ', upper(title), ' ') AS title, book_id % 3 AS author, concat('B', CAST(book_id AS VARCHAR)) AS asin FROM books WHERE book_id % 2 = 0),
k AS (SELECT trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS title, author, arg_max(asin, id) AS asin FROM l GROUP BY 1, 2)
SELECT b.book_id, k.asin FROM books b JOIN k ON k.title = trim(regexp_replace(lower(b.title), '\\s+', ' ', 'g')) AND k.author = b.book_id % 3""")
def learned_lookup(spark, d):
    books = frame(spark, d, "books").select("book_id", N.normal_words(F.col("title")).alias("title"), (F.col("book_id") % 3).alias("author"))
    learned = frame(spark, d, "books").where("book_id % 2 = 0").select("book_id", N.normal_words(F.concat(F.lit("  "), F.upper("title"), F.lit(" "))).alias("title"), (F.col("book_id") % 3).alias("author"))
    latest = learned.groupBy("title", "author").agg(F.max_by(F.concat(F.lit("B"), F.col("book_id")), "book_id").alias("asin"))
    return books.join(latest, ["title", "author"]).select("book_id", "asin")


_CAP = "concat(upper(substr({0}, 1, 1)), lower(substr({0}, 2)))"
_ADJ, _NOUN = (_CAP.format(f"split_part(p_name, ' ', {i})") for i in (1, 2))
_INTRO = f"concat('This is ', p_name, '. Written by ', {_ADJ}, ' ', {_NOUN}, ' and READ BY ', {_CAP.format('p_type')}, ' Voice. More by J. ', {_NOUN}, '; by Third One, and this is it, narrated by nobody')"


@query("stated_names", f"SELECT p_partkey, 'title' AS kind, p_name AS value, 0.7::DOUBLE AS confidence FROM part UNION ALL SELECT p_partkey, 'author', concat({_ADJ}, ' ', {_NOUN}), 0.85 FROM part UNION ALL SELECT p_partkey, 'author', concat('J. ', {_NOUN}), 0.85 FROM part UNION ALL SELECT p_partkey, 'narrator', concat({_CAP.format('p_type')}, ' Voice'), 0.9 FROM part")
def stated_names(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", f"{_INTRO} AS text")
    return rows.select("p_partkey", F.explode(X.stated_names(F.col("text"))).alias("n")).select("p_partkey", "n.*")


@query("page_text")
def page_text(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", N.strip_html(F.col("html")).alias("text"))


@query("html_tags_out", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def html_tags_out(spark, d):
    html = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.trim(html).alias("text"))


@query("slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_-]', '', 'g'), '[-_]+', '-', 'g'), '-') AS tag, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 \\t_-]', '', 'g'), '[ \\t_-]+', '-', 'g'), '-') AS setting FROM part")
def slugs(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", N.slugify(F.col("p_type")).alias("slug"), N.tag(F.col("p_name")).alias("tag"), N.setting_tag(F.col("p_name")).alias("setting"))


@query("filename_slugs", "SELECT page_id, coalesce(nullif(trim(trim(regexp_replace(url, '[^A-Za-z0-9._]+', '-', 'g'), '-')[1:80], '-'), ''), 'book') AS slug FROM pages")
def filename_slugs(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", N.filename_slug(F.col("url")).alias("slug"))


@query("long_dates", "SELECT o_orderkey, concat(monthname(o_orderdate), ' ', CAST(day(o_orderdate) AS VARCHAR), ', ', CAST(year(o_orderdate) AS VARCHAR)) AS long FROM orders")
def long_dates(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", N.long_date(F.col("o_orderdate")).alias("long"))


@query("split_values", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '[;/,|]'), lambda x: trim(x)), lambda x: x <> ''), '#') AS parts FROM documents")
def split_values(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(N.split_values(F.col("text")), "#").alias("parts"))


@query("split_text", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '[;/,|]'), lambda x: trim(x)), lambda x: x <> ''), '#') AS parts FROM documents")
def split_text(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(N.split_values(F.col("text")), "#").alias("parts"))


@query("clamped_tags", "SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS tags FROM (SELECT p_partkey, list_filter([t1, CASE WHEN t2 <> t1 THEN t2 ELSE '' END], lambda x: x <> '') AS list_distinct_ordered FROM (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS t1, lower(split_part(p_name, ' ', 2)) AS t2 FROM part))")
def clamped_tags(spark, d):
    tags = F.split("p_name", " ")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_join(N.clamp_tags(tags, 2), ",").alias("tags"))


@query("json_diff", """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS a, lead(json_extract_string(props, '$.k')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, CASE WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS kind, a AS before, b AS after FROM e WHERE a IS DISTINCT FROM b""")
def json_diff(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "props", F.coalesce(F.lead("props").over(w), F.lit("{}")).alias("next"))
    return e.select("event_id", F.explode(S.json_diff(F.col("props"), F.col("next"))).alias("c")).select("event_id", "c.kind", "c.before", "c.after")


@query("transcripts", "SELECT conv_id AS book_id, string_agg(text, ' ' ORDER BY turn) AS text, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def transcripts(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("idx", "said")))
    rows = frame(spark, d, "segments").groupBy("book_id").agg(ordered.alias("s"), F.sum(F.char_length("said")).alias("chars"))
    return rows.select("book_id", F.array_join(F.transform("s", lambda x: x["said"]), " ").alias("text"), "chars")


@query("subtitles", with_("segments") + """SELECT book_id, string_agg(concat(CAST(idx + 1 AS VARCHAR), chr(10), format('{:02d}:{:02d}:{:02d},000 --> {:02d}:{:02d}:{:02d},000', idx * 5 // 3600, idx * 5 // 60 % 60, idx * 5 % 60, (idx + 1) * 5 // 3600, (idx + 1) * 5 // 60 % 60, (idx + 1) * 5 % 60), chr(10), replace(said, chr(10), ' '), chr(10)), chr(10) ORDER BY idx) AS srt FROM segments GROUP BY book_id""")
def subtitles(spark, d):
    rows = frame(spark, d, "segments").selectExpr("book_id", "idx", "idx * 5000 AS start_ms", "(idx + 1) * 5000 AS end_ms", "said AS title")
    return formats.srt(rows, "book_id")


@query("playlists", with_("files") + "SELECT book_id, concat('#EXTM3U', chr(10), string_agg(concat('#EXTINF:', CAST(CASE WHEN duration_ms IS NULL THEN -1 ELSE duration_ms // 1000 END AS VARCHAR), ',', CAST(file_id AS VARCHAR)), chr(10) ORDER BY file_id, duration_ms NULLS FIRST)) AS m3u8 FROM files GROUP BY book_id")
def playlists(spark, d):
    return formats.m3u8(frame(spark, d, "files"), "book_id")


@query("cue_times", "SELECT o_orderkey, CASE WHEN o_orderkey % 70 < 60 AND o_orderkey % 80 < 75 THEN o_orderkey % 100 * 60000 + o_orderkey % 70 * 1000 + (o_orderkey % 80 * 1000 + 37) // 75 END AS ms FROM orders")
def cue_times(spark, d):
    stamp = F.format_string("%02d:%02d:%02d", F.col("o_orderkey") % 100, F.col("o_orderkey") % 70, F.col("o_orderkey") % 80)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", formats.cue_ms(stamp).alias("ms"))


@query("tag_candidates", with_("books") + "SELECT book_id, field, value FROM (SELECT book_id, 'title' AS field, title AS value FROM books UNION ALL SELECT book_id, 'language', language FROM books UNION ALL SELECT book_id, 'subtitle', trim(x) FROM (SELECT book_id, unnest(string_split_regex(subtitle, '[;/,|]')) AS x FROM books)) WHERE value <> ''")
def tag_candidates(spark, d):
    return formats.candidates(frame(spark, d, "books"), "book_id", ["title", "language"], ["subtitle"]).select("book_id", "field", "value")
