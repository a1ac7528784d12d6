"""Codes, releases, chapters and signatures over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import codes as N
from lectern.operators import timeline as T
from lectern.plans.standins import frame, with_

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


_SPELT = "CASE doc_id % 9 WHEN 0 THEN upper(lang) WHEN 1 THEN concat(lang, '-AT') WHEN 2 THEN ' ger ' WHEN 3 THEN 'English' WHEN 4 THEN 'Klingon' WHEN 5 THEN 'zh-HANS' WHEN 6 THEN 'français' WHEN 7 THEN 'spa' ELSE lang END"


@query("language_codes", f"""WITH s AS (SELECT doc_id, lang, {_SPELT} AS spelt FROM documents),
c AS (SELECT doc_id, CASE doc_id % 9 WHEN 2 THEN 'de' WHEN 3 THEN 'en' WHEN 4 THEN NULL WHEN 5 THEN 'zh-Hans' WHEN 6 THEN 'fr' WHEN 7 THEN 'es' ELSE lang END AS code FROM s)
SELECT doc_id, code, CASE code WHEN 'en' THEN 'Englisch' WHEN 'de' THEN 'Deutsch' WHEN 'fr' THEN 'Französisch' WHEN 'es' THEN 'Spanisch' WHEN 'zh-Hans' THEN 'Mandarin (Vereinfacht)' ELSE 'Unknown' END AS name FROM c""")
def language_codes(spark, d):
    rows = _read(spark, d, "documents").select("doc_id", N.language_code(F.expr(_SPELT)).alias("code"))
    return rows.withColumn("name", N.language_name(F.col("code"), "de-CH"))


_GENRES = ["Sci-Fi", "  FANTASY ", "Children's Non-Fiction", "Self—Help", "Krimi", "", None, "true crime"]


@query("genre_codes", "SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'science-fiction' WHEN 1 THEN 'fantasy' WHEN 2 THEN 'children-non-fiction' WHEN 3 THEN 'self-help' WHEN 4 THEN 'mystery' WHEN 7 THEN 'true-crime' END AS genre FROM part")
def genre_codes(spark, d):
    return _read(spark, d, "part").select("p_partkey", N.genre_code(F.get(F.array(*map(F.lit, _GENRES)), F.col("p_size") % 8)).alias("genre"))


_RELEASE = "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '2200-01-01T00:00:00Z' WHEN 2 THEN '  ' WHEN 3 THEN 'soon' WHEN 4 THEN concat(substr(CAST(o_orderdate AS VARCHAR(40)), 1, 10), 'T00:00:00-07:00') ELSE substr(CAST(o_orderdate AS VARCHAR(40)), 1, 10) END"


@query("release_states", f"""SELECT o_orderkey, CASE WHEN trim(coalesce(r, '')) = '' THEN 'unknown' WHEN r = '2200-01-01T00:00:00Z' THEN 'announced' WHEN r = 'soon' THEN 'unknown'
  WHEN CAST(r[1:10] AS TIMESTAMP) + CASE WHEN length(r) > 10 THEN INTERVAL 7 HOUR ELSE INTERVAL 0 HOUR END > TIMESTAMP '1996-06-01' THEN 'scheduled' ELSE 'released' END AS state,
  coalesce(r > '1996-06-01' AND r <= '1997-01-01', false) AS upcoming FROM (SELECT o_orderkey, {_RELEASE} AS r FROM orders)""")
def release_states(spark, d):
    r = F.expr(_RELEASE.replace("VARCHAR(40)", "STRING"))
    now = F.to_timestamp(F.lit("1996-06-01T00:00:00Z"))
    return _read(spark, d, "orders").select("o_orderkey", N.release_state(r, now).alias("state"), N.in_window(r, "1996-06-01", "1997-01-01").alias("upcoming"))


@query("years_and_types", "SELECT o_orderkey, CAST(epoch(date_trunc('year', o_orderdate)) AS BIGINT) AS year_start, CASE o_orderstatus WHEN 'F' THEN 'audio/mpeg' WHEN 'O' THEN 'audio/mp4' ELSE 'application/octet-stream' END AS media_type FROM orders")
def years_and_types(spark, d):
    form = F.expr("CASE o_orderstatus WHEN 'F' THEN 'MP3' WHEN 'O' THEN 'm4b' ELSE o_orderstatus END")
    return _read(spark, d, "orders").select("o_orderkey", N.year_start(F.col("o_orderdate").cast("timestamp")).alias("year_start"), N.media_type(form).alias("media_type"))


@query("title_sorts", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'a') AND length(trim(p_name[2:])) > 0 THEN trim(p_name[2:]) ELSE p_name END AS title_sort FROM part")
def title_sorts(spark, d):
    return _read(spark, d, "part").select("p_partkey", N.title_sort(F.col("p_name"), F.lit("a")).alias("title_sort"))


_PHRASES = [("in the", "First House"), ("of the", "Second House"), ("qu", "First House"), ("zzzz", "Nobody")]


@query("publisher_phrases", """SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'in the') OR contains(lower(text), 'qu') THEN 'First House' END, CASE WHEN contains(lower(text), 'of the') THEN 'Second House' END) AS by_first,
  CAST((contains(lower(text), 'in the') OR contains(lower(text), 'qu')) AS INTEGER) + CAST(contains(lower(text), 'of the') AS INTEGER) AS n FROM documents WHERE text IS NOT NULL""")
def publisher_phrases(spark, d):
    who = N.matching_phrases(F.col("text"), _PHRASES)
    return _read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(F.array_sort(who), ",").alias("by_first"), F.size(who).alias("n"))


@query("samples_to_pcm", "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(round(greatest(-1, least(1, x::DOUBLE)) * 32767) AS BIGINT))) AS BIGINT) AS total, CAST(round(greatest(-1, least(1, embedding[1]::DOUBLE)) * 32767) AS INTEGER) AS first FROM embeddings")
def samples_to_pcm(spark, d):
    pcm = N.pcm16(F.col("embedding"))
    return _read(spark, d, "embeddings").select("vec_id", F.aggregate(pcm, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.get(pcm, 0).cast("int").alias("first"))


_CUTS = "SELECT file_id, greatest(0, duration_ms // 10 - 1000) AS cut_ms FROM files WHERE NOT is_active"


@query("cuts_before", with_("files") + f""", f AS (SELECT file_id, any_value(book_id) AS book_id, max(duration_ms) AS duration_ms FROM files GROUP BY file_id), c AS (SELECT file_id, sum(cut_ms) AS cut_ms FROM ({_CUTS}) GROUP BY file_id)
SELECT f.book_id, f.file_id, CAST(coalesce(sum(coalesce(duration_ms, 0) - coalesce(cut_ms, 0)) OVER (PARTITION BY f.book_id ORDER BY f.file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_ms FROM f LEFT JOIN c ON c.file_id = f.file_id""")
def cuts_before(spark, d):
    files = frame(spark, d, "files")
    each = files.groupBy("file_id", "book_id").agg(F.max("duration_ms").alias("duration_ms"))
    return T.cut_before(each, files.where("NOT is_active").selectExpr("file_id", "duration_ms div 10 - 1000 AS cut_ms")).select("book_id", "file_id", "before_ms")


@query("merged_chapters", with_("files") + """, u AS (SELECT file_id, any_value(book_id) AS book_id, max(duration_ms) AS duration_ms, bool_or(is_active) AS is_active FROM files GROUP BY file_id), f AS (SELECT book_id, file_id, duration_ms, row_number() OVER (PARTITION BY book_id ORDER BY file_id) AS part,
    coalesce(sum(greatest(coalesce(duration_ms, 0), 0)) OVER (PARTITION BY book_id ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS file_ms FROM u),
c AS (SELECT file_id, i AS idx, (i - 1) * 90000 AS a0, CASE WHEN i = 2 THEN ' ' ELSE concat('Scene ', CAST(i AS VARCHAR)) END AS title FROM u, (SELECT unnest(range(1, 4)) AS i) WHERE is_active),
r AS (SELECT f.*, a0, idx, c.title, CASE WHEN a0 IS NULL THEN duration_ms ELSE coalesce(lead(a0) OVER (PARTITION BY f.book_id, f.file_id ORDER BY a0, idx), greatest(a0, coalesce(duration_ms, a0))) END AS e FROM f LEFT JOIN c ON c.file_id = f.file_id),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY part, a0, idx) AS nth FROM r WHERE a0 IS NOT NULL OR duration_ms > 0)
SELECT book_id, CAST(nth AS INTEGER) AS nth, CAST(file_ms + coalesce(a0, 0) AS BIGINT) AS start_ms, CAST(file_ms + e AS BIGINT) AS end_ms, CASE WHEN a0 IS NULL THEN concat('Part ', CAST(part AS VARCHAR)) WHEN trim(title) = '' THEN concat('Chapter ', CAST(nth AS VARCHAR)) ELSE title END AS title FROM n""")
def merged_chapters(spark, d):
    files = frame(spark, d, "files").groupBy("file_id", "book_id").agg(F.max("duration_ms").alias("duration_ms"), F.bool_or("is_active").alias("is_active"))
    own = files.where("is_active").select("file_id", F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit((i - 1) * 90000).cast("long").alias("start_ms"), F.lit(" " if i == 2 else f"Scene {i}").alias("title")) for i in (1, 2, 3)])).alias("c")).select("file_id", "c.*")
    return T.merged_chapters(files.select("book_id", "file_id", "duration_ms"), own)


_ASCII = "regexp_replace(text, '[^ -~\\n]', '_'{g})"


@query("chapter_marks", f"""WITH t AS (SELECT doc_id AS book_id, {_ASCII.format(g=", 'g'")} AS text FROM documents WHERE text <> ''),
c AS (SELECT book_id, text, i, CAST(least(floor(i / 4.0 * length(text)), length(text)) AS BIGINT) AS a0 FROM t, (SELECT unnest(range(0, 4)) AS i)),
m AS (SELECT *, CASE WHEN i = 0 THEN 0 WHEN a0 >= length(text) THEN length(text) WHEN text[a0 + 1] IN (' ', chr(10)) THEN a0 + length(regexp_extract(text[a0 + 1:], '^[ \\n]+')) ELSE length(regexp_replace(text[1:a0], '[^ \\n]+$', '')) END AS moved FROM c),
o AS (SELECT *, max(moved) OVER (PARTITION BY book_id ORDER BY i) AS from_byte FROM m)
SELECT book_id, i AS idx, CAST(from_byte AS INTEGER) AS from_byte, CAST(coalesce(lead(from_byte) OVER (PARTITION BY book_id ORDER BY i), length(text)) AS INTEGER) AS to_byte FROM o""")
def chapter_marks(spark, d):
    texts = _read(spark, d, "documents").where("text <> ''").select(F.col("doc_id").alias("book_id"), F.lit(4000).alias("total_ms"), F.regexp_replace("text", r"[^ -~\n]", "_").alias("text"))
    chapters = texts.select("book_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("idx")).withColumn("start_ms", F.col("idx") * 1000)
    return T.chapter_marks(chapters, texts)


_TITLES = "CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Chapter 7.' WHEN 2 THEN ' 012 ' WHEN 3 THEN 'A real title' ELSE 'pt. 3' END"


@query("placeholder_titles", f"""WITH w AS (SELECT l_orderkey AS book_id, l_partkey * 100000 + l_linenumber * 10000 + l_suppkey AS idx, {_TITLES} AS title, (l_orderkey + l_linenumber) % 5 <> 3 AS empty FROM lineitem),
s AS (SELECT l_orderkey AS book_id, l_partkey * 100000 + l_linenumber * 10000 + l_suppkey AS idx, CASE WHEN l_linenumber = 2 THEN '' ELSE concat('Named ', l_shipdate::DATE::VARCHAR) END AS title FROM lineitem WHERE NOT (l_orderkey % 4 = 0 AND l_linenumber = 1)),
a AS (SELECT book_id, title, empty, row_number() OVER (PARTITION BY book_id ORDER BY idx) AS nth, count(*) OVER (PARTITION BY book_id) AS n, count_if(empty) OVER (PARTITION BY book_id) AS k FROM w),
b AS (SELECT book_id, title AS other, row_number() OVER (PARTITION BY book_id ORDER BY idx) AS nth, count(*) OVER (PARTITION BY book_id) AS n FROM s)
SELECT a.book_id, CAST(a.nth AS INTEGER) AS nth, CASE WHEN empty AND other <> '' THEN other ELSE title END AS title FROM a JOIN b ON a.book_id = b.book_id AND a.nth = b.nth AND a.n = b.n WHERE k * 2 >= a.n""")
def placeholder_titles(spark, d):
    lines = _read(spark, d, "lineitem")
    own = lines.select(F.col("l_orderkey").alias("book_id"), F.expr("l_partkey * 100000 + l_linenumber * 10000 + l_suppkey").alias("idx"), F.expr(_TITLES).alias("title"))
    other = lines.where("NOT (l_orderkey % 4 = 0 AND l_linenumber = 1)").select(
        F.col("l_orderkey").alias("book_id"), F.expr("l_partkey * 100000 + l_linenumber * 10000 + l_suppkey").alias("idx"), F.when(F.col("l_linenumber") == 2, "").otherwise(F.concat(F.lit("Named "), F.to_date("l_shipdate").cast("string"))).alias("title"))
    return T.titled(own, other, "book_id", "idx")


@query("catalog_chapters", with_("chapters") + ", c AS (SELECT book_id, idx, max(length_ms) AS length_ms FROM chapters GROUP BY book_id, idx) SELECT book_id, idx, CAST(coalesce(sum(length_ms) OVER w, 0) AS BIGINT) AS start_ms, CAST(coalesce(sum(length_ms) OVER w, 0) + length_ms AS BIGINT) AS end_ms FROM c WINDOW w AS (PARTITION BY book_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def catalog_chapters(spark, d):
    return T.offsets(frame(spark, d, "chapters").groupBy("book_id", "idx").agg(F.max("length_ms").alias("length_ms")), "book_id", ["idx"], "length_ms").select("book_id", "idx", "start_ms", "end_ms")


def _bits(spark, d):
    return _read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.when(x > 0, 65535).otherwise(0)).alias("hashes"))


def _signatures(spark, d):
    """Of each label the first vector's start, middle and end: a library of as many signatures as labels."""
    first = _bits(spark, d).groupBy("label").agg(F.min_by("hashes", "vec_id").alias("h"))
    return first.select(F.col("label").cast("long").alias("signature_id"), (F.col("label") % 2).alias("kind"), F.slice("h", 5, 24).alias("hashes"), F.slice("h", 5, 8).alias("head"), F.slice("h", 40, 8).alias("tail"), F.lit(0.65).alias("threshold"))


_SIG = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 65535 ELSE 0 END) AS h FROM embeddings),
s AS (SELECT label AS signature_id, label % 2 AS kind, arg_min(h, vec_id) AS h FROM e GROUP BY label),
g AS (SELECT signature_id, kind, h[5:28] AS own, h[5:12] AS head, h[40:47] AS tail FROM s),
p AS (SELECT vec_id, signature_id, e.h, own, head, tail FROM e JOIN g ON g.kind = e.label % 2),
f AS (SELECT vec_id, signature_id, min(CAST(list_sum(list_transform(range(1, 25), lambda i: bit_count(xor(own[i], h[i + o])))) AS BIGINT)) AS d FROM p, (SELECT unnest(range(0, 41)) AS o) GROUP BY 1, 2),
a AS (SELECT vec_id, signature_id, tail, h, o, CAST(list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(head[i], h[i + o])))) AS BIGINT) AS d FROM p, (SELECT unnest(range(0, 57)) AS o)),
a1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, signature_id ORDER BY d, o) AS k FROM a) WHERE k = 1),
b AS (SELECT vec_id, signature_id, a1.d AS hd, a1.o AS ho, t.o AS to_, CAST(list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(tail[i], h[i + t.o])))) AS BIGINT) AS td FROM a1 JOIN (SELECT unnest(range(0, 57)) AS o) t ON t.o >= a1.o + 8),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, signature_id ORDER BY td, to_) AS k FROM b) WHERE k = 1) """


@query("bookend_matches", _SIG + "SELECT vec_id, CAST(signature_id AS BIGINT) AS signature_id, CAST(ho AS INTEGER) AS head_at, hd AS head_distance, CAST(to_ AS INTEGER) AS tail_at, td AS tail_distance FROM b1 WHERE to_ - ho - 8 <= 30")
def bookend_matches(spark, d):
    rows = _bits(spark, d).withColumn("kind", F.col("label") % 2).join(_signatures(spark, d).drop("hashes"), "kind")
    rows = T.bookend(rows, 30).where("ends IS NOT NULL")
    return rows.select("vec_id", "signature_id", F.col("ends.head_offset").alias("head_at"), "ends.head_distance", F.col("ends.tail_offset").alias("tail_at"), "ends.tail_distance")


@query("signature_detection", _SIG + """, c AS (SELECT vec_id, signature_id, 0 AS m, 1 - d / 768.0 AS conf FROM f UNION ALL SELECT vec_id, signature_id, 1, 1 - greatest(hd, td) / 256.0 FROM b1)
SELECT vec_id AS window_id, CAST(signature_id AS BIGINT) AS signature_id, CASE m WHEN 0 THEN 'full' ELSE 'bookend' END AS method, round(conf, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY m, conf DESC, signature_id) AS k FROM c WHERE conf >= 0.65) WHERE k = 1""")
def signature_detection(spark, d):
    windows = _bits(spark, d).select(F.col("vec_id").alias("window_id"), (F.col("label") % 2).alias("kind"), "hashes")
    return T.detected(windows, _signatures(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("sliding_cosine", """WITH s AS (SELECT label, arg_min(embedding, vec_id)[1:12]::DOUBLE[] AS n FROM embeddings GROUP BY label),
c AS (SELECT vec_id, o, list_cosine_similarity(n, embedding[o + 1:o + 12]::DOUBLE[]) AS c FROM embeddings e JOIN s ON s.label = e.label, (SELECT unnest(range(0, 53)) AS o))
SELECT vec_id, CAST(o AS INTEGER) AS place, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, o) AS k FROM c) WHERE k = 1""")
def sliding_cosine(spark, d):
    e = _read(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.slice(F.min_by("embedding", "vec_id"), 1, 12).alias("needle"))
    return e.join(first, "label").select("vec_id", T.best_cosine(F.col("needle"), F.col("embedding")).alias("b")).select("vec_id", F.col("b.offset").alias("place"), F.round("b.cosine", 6).alias("cosine"))


@query("compatible_publishers", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey AND (contains(lower(a.n_name), lower(b.n_name[1:2])) OR contains(lower(b.n_name[1:2]), lower(a.n_name)))")
def compatible_publishers(spark, d):
    n = _read(spark, d, "nation")
    seeds = n.select(F.col("n_nationkey").alias("b"), "n_regionkey", F.concat(F.lit(" "), F.upper(F.substring("n_name", 1, 2))).alias("seed"))
    return n.select(F.col("n_nationkey").alias("a"), "n_regionkey", "n_name").join(seeds, "n_regionkey").where(T.compatible(F.col("n_name"), F.col("seed")) & (F.col("a") != F.col("b"))).select("a", "b")


@query("windows_in_files", with_("files") + """, u AS (SELECT file_id, any_value(book_id) AS book_id, max(duration_ms) AS duration_ms FROM files GROUP BY file_id), f AS (SELECT book_id, file_id, coalesce(sum(coalesce(duration_ms, 0)) OVER (PARTITION BY book_id ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, coalesce(duration_ms, 0) AS n FROM u),
t AS (SELECT book_id, sum(n) AS total FROM f GROUP BY book_id), w AS (SELECT book_id, p, CAST(floor(total * p) AS BIGINT) AS a0 FROM t, (SELECT unnest([0.1, 0.5, 0.99]::DOUBLE[]) AS p))
SELECT w.book_id, file_id, p AS part, CAST(a0 - s AS BIGINT) AS from_ms, CAST(least(30000, s + n - a0) AS BIGINT) AS length_ms FROM w JOIN f ON f.book_id = w.book_id AND a0 >= s AND a0 < s + n WHERE least(30000, s + n - a0) > 1000""")
def windows_in_files(spark, d):
    return T.windows_at(T.offsets(frame(spark, d, "files").groupBy("file_id", "book_id").agg(F.max("duration_ms").alias("duration_ms")), "book_id", ["file_id"], "duration_ms"), (0.1, 0.5, 0.99), 30)


_METHODS = "CASE l_linenumber % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'fingerprint_full' WHEN 2 THEN 'fingerprint_bookend' ELSE 'transcript' END"
_STATUS = "CASE l_returnflag WHEN 'A' THEN 'applied' WHEN 'N' THEN 'candidate' ELSE 'rejected' END"
_NEXT = "CASE l_linestatus WHEN 'O' THEN 'applied' ELSE 're_detected' END"


@query("review_transitions", f"""SELECT l_orderkey, l_linenumber, (s = 'candidate') OR (s = 'applied' AND n = 're_detected') AS allowed, m = 'manual' OR (m = 'fingerprint_full' AND c >= 0.85) OR (m = 'fingerprint_bookend' AND c >= 0.8) AS self
FROM (SELECT l_orderkey, l_linenumber, {_STATUS} AS s, {_NEXT} AS n, {_METHODS} AS m, 1 - l_discount * 2 AS c FROM lineitem)""")
def review_transitions(spark, d):
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.may_become(F.expr(_STATUS), F.expr(_NEXT)).alias("allowed"), T.applies_itself(F.expr(_METHODS), 1 - F.col("l_discount") * 2).alias("self"))


_SAID = ["quite", "the", "nothing like it"]


@query("stated_phrases", with_("segments") + """, t AS (SELECT book_id, idx, idx * 5000 AS s, lower(coalesce(said, '')) AS low, max((idx + 1) * 5000) OVER (PARTITION BY book_id) AS total FROM segments),
e AS (SELECT *, 'head' AS place FROM t WHERE s < 10000 UNION ALL SELECT *, 'tail' FROM t WHERE s + 5000 > total - 5000),
o AS (SELECT *, coalesce(sum(length(low) + 1) OVER (PARTITION BY book_id, place ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM e),
j AS (SELECT book_id, place, string_agg(low, ' ' ORDER BY idx) AS whole FROM e GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY book_id, place ORDER BY a0, i) AS k FROM (SELECT book_id, place, p, i, instr(whole, p) - 1 AS a0 FROM j, (VALUES ('quite', 0), ('the', 1), ('nothing like it', 2)) v(p, i) WHERE instr(whole, p) > 0))
SELECT h.book_id, h.place, p AS phrase, max(s) AS at_ms FROM h JOIN o ON o.book_id = h.book_id AND o.place = h.place AND o.f <= h.a0 WHERE k = 1 GROUP BY 1, 2, 3""")
def stated_phrases(spark, d):
    s = frame(spark, d, "segments").select("book_id", "idx", (F.col("idx") * 5000).alias("start_ms"), ((F.col("idx") + 1) * 5000).alias("end_ms"), F.col("said").alias("text"))
    return T.stated_phrase(s, _SAID, 10_000, 5_000)
