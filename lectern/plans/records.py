"""Identity, journal, progress, details and search over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import catalog as C
from lectern.operators import facets
from lectern.operators import identity as I
from lectern.operators import search as X
from lectern.operators import state as S
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


_PAIRS = "p AS (SELECT DISTINCT book_id, author_id AS candidate FROM books UNION SELECT DISTINCT book_id, narrator_id FROM book_narrator)"
_AUTHOR = """, s AS (SELECT book_id, candidate,
  CASE WHEN EXISTS (SELECT 1 FROM book_narrator n JOIN book_narrator m ON m.narrator_id = n.narrator_id AND m.book_id <> n.book_id JOIN books b ON b.book_id = m.book_id AND b.author_id = p.candidate WHERE n.book_id = p.book_id) THEN 0.4::DOUBLE ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM books a JOIN books b ON b.publisher_id = a.publisher_id AND b.book_id <> a.book_id AND b.author_id = p.candidate WHERE a.book_id = p.book_id) THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM book_series n JOIN book_series m ON m.series_id = n.series_id AND m.book_id <> n.book_id JOIN books b ON b.book_id = m.book_id AND b.author_id = p.candidate WHERE n.book_id = p.book_id) THEN 0.5::DOUBLE ELSE 0 END AS score FROM p) """
_EVIDENCE = with_("books", "book_narrator", "book_series", "authors") + ", " + _PAIRS


def _tables(spark, d):
    books, narrators, series = (frame(spark, d, n) for n in ("books", "book_narrator", "book_series"))
    pairs = books.select("book_id", F.col("author_id").alias("candidate")).unionByName(narrators.select("book_id", F.col("narrator_id").alias("candidate")))
    return books, narrators, series, pairs


@query("author_evidence", _EVIDENCE + _AUTHOR + "SELECT book_id, candidate, round(score, 6) AS score FROM s")
def author_evidence(spark, d):
    books, narrators, series, pairs = _tables(spark, d)
    return I.author_scores(pairs, books, narrators, series).select("book_id", "candidate", F.round("score", 6).alias("score"))


@query("narrator_evidence", _EVIDENCE + """SELECT book_id, candidate, CASE WHEN EXISTS (SELECT 1 FROM books a JOIN books b ON b.publisher_id = a.publisher_id AND b.book_id <> a.book_id JOIN book_narrator m ON m.book_id = b.book_id AND m.narrator_id = p.candidate WHERE a.book_id = p.book_id) THEN 0.2::DOUBLE ELSE 0 END AS score FROM p""")
def narrator_evidence(spark, d):
    books, narrators, _, pairs = _tables(spark, d)
    return I.narrator_scores(pairs, books, narrators)


@query("series_evidence", with_("books", "book_series") + """, p AS (SELECT DISTINCT book_id, series_id AS candidate FROM book_series)
SELECT book_id, candidate, CASE WHEN EXISTS (SELECT 1 FROM books a JOIN books b ON b.author_id = a.author_id AND b.book_id <> a.book_id JOIN book_series m ON m.book_id = b.book_id AND m.series_id = p.candidate WHERE a.book_id = p.book_id) THEN 0.6::DOUBLE ELSE 0 END AS score FROM p""")
def series_evidence(spark, d):
    books, _, series, _ = _tables(spark, d)
    return I.series_scores(series.select("book_id", F.col("series_id").alias("candidate")), books, series)


@query("pending_choices", _EVIDENCE + _AUTHOR + "SELECT book_id, count(*) AS n, string_agg(concat(CAST(candidate AS VARCHAR), ' ', name), '; ' ORDER BY -score, candidate) AS choices FROM s JOIN authors a ON a.author_id = s.candidate GROUP BY book_id")
def pending_choices(spark, d):
    books, narrators, series, pairs = _tables(spark, d)
    names = frame(spark, d, "authors").select(F.col("author_id").alias("candidate"), F.col("name").alias("display"))
    out = I.pending_authors(pairs, books, narrators, series, names)
    return out.select("book_id", F.size("candidates").cast("long").alias("n"), F.array_join(F.transform("candidates", lambda c: F.concat_ws(" ", c["id"], c["display"])), "; ").alias("choices"))


@query("identity_cascade", with_("books", "book_narrator", "book_series", "authors") + """, k AS (SELECT author_id AS entity_id, concat('Pen ', CAST(author_id % 5 AS VARCHAR)) AS alias, CASE WHEN author_id % 4 = 0 THEN concat('X', CAST(author_id AS VARCHAR)) END AS external_id FROM authors),
n AS (SELECT book_id AS row_id, concat('PEN ', CAST(book_id % 7 AS VARCHAR), ' ') AS name, CASE WHEN book_id % 10 = 0 THEN concat('X', CAST(book_id % 12 AS VARCHAR)) END AS external_id FROM books),
i AS (SELECT n.row_id, min(entity_id) AS by_id FROM n JOIN k ON k.external_id = n.external_id GROUP BY 1),
e AS (SELECT DISTINCT n.row_id, entity_id FROM n JOIN k ON lower(trim(n.name)) = lower(trim(k.alias))), c AS (SELECT row_id, count(*) AS n, min(entity_id) AS only_one FROM e GROUP BY 1),
p AS (SELECT e.row_id AS book_id, entity_id AS candidate FROM e JOIN c ON c.row_id = e.row_id AND c.n > 1 WHERE e.row_id NOT IN (SELECT row_id FROM i))""" + _AUTHOR + """,
r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, candidate) AS k, lead(score) OVER (PARTITION BY book_id ORDER BY score DESC, candidate) AS next FROM s), w AS (SELECT book_id, candidate FROM r WHERE k = 1 AND (next IS NULL OR score - next > 0.3))
SELECT n.row_id, CASE WHEN by_id IS NOT NULL THEN 'external' WHEN c.n = 1 THEN 'alias' WHEN w.candidate IS NOT NULL THEN 'corroborated' WHEN c.n > 1 THEN 'deferred' ELSE 'new' END AS outcome, coalesce(by_id, CASE WHEN c.n = 1 THEN only_one END, w.candidate) AS entity_id
FROM n LEFT JOIN i ON i.row_id = n.row_id LEFT JOIN c ON c.row_id = n.row_id LEFT JOIN w ON w.book_id = n.row_id""")
def identity_cascade(spark, d):
    books, narrators, series, _ = _tables(spark, d)
    known = frame(spark, d, "authors").selectExpr("author_id AS entity_id", "concat('Pen ', author_id % 5) AS alias", "CASE WHEN author_id % 4 = 0 THEN concat('X', author_id) END AS external_id")
    names = books.selectExpr("book_id AS row_id", "concat('PEN ', book_id % 7, ' ') AS name", "CASE WHEN book_id % 10 = 0 THEN concat('X', book_id % 12) END AS external_id")
    out = I.cascade(names, known, lambda asked, entities: I.leading_authors(asked, entities, books, narrators, series))
    return out.select("row_id", "outcome", F.when(F.col("outcome") != "new", F.col("entity_id")).alias("entity_id"))


@query("exalted_aliases", with_("authors", "author_aliases") + """, w AS (SELECT author_id, CASE WHEN author_id % 2 = 0 THEN upper(concat('Pen ', name)) ELSE concat('Quill ', name) END AS wanted FROM authors)
SELECT a.author_id, a.alias, lower(a.alias) = lower(wanted) AS is_prime FROM author_aliases a JOIN w ON w.author_id = a.author_id
UNION ALL SELECT w.author_id, wanted, true FROM w WHERE NOT EXISTS (SELECT 1 FROM author_aliases a WHERE a.author_id = w.author_id AND lower(a.alias) = lower(wanted))""")
def exalted_aliases(spark, d):
    chosen = frame(spark, d, "authors").selectExpr("author_id", "CASE WHEN author_id % 2 = 0 THEN upper(concat('Pen ', name)) ELSE concat('Quill ', name) END AS alias")
    return I.exalted(frame(spark, d, "author_aliases"), chosen, "author_id")


@query("alias_lines", "SELECT DISTINCT doc_id, trim(a) AS alias FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS a FROM documents) WHERE trim(a) <> ''")
def alias_lines(spark, d):
    return I.split_aliases(_read(spark, d, "documents"), "doc_id", "text")


@query("author_gaps", with_("books", "book_series") + """, g AS (SELECT series_id, list_sort(list(DISTINCT CAST(round(position) AS BIGINT)) FILTER (abs(position - round(position)) < 1e-6 AND position >= 0)) AS w FROM book_series GROUP BY series_id),
m AS (SELECT series_id, list_filter(range(w[1], w[-1]), lambda x: NOT list_contains(w, x)) AS missing FROM g WHERE len(w) >= 2)
SELECT DISTINCT author_id, m.series_id, array_to_string(missing, ',') AS missing FROM m JOIN book_series s ON s.series_id = m.series_id JOIN books b ON b.book_id = s.book_id WHERE len(missing) > 0""")
def author_gaps(spark, d):
    return I.gaps_of_authors(frame(spark, d, "books"), frame(spark, d, "book_series")).withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


_RAW = "SELECT l_orderkey AS book_id, l_partkey * 1000 + l_linenumber * 100 + l_suppkey AS place, concat(' Tag_', CAST(l_suppkey % 5 AS VARCHAR{n})) AS parent, concat('tag-', CAST(l_linenumber % 5 AS VARCHAR{n}), '!') AS child FROM lineitem"


@query("tag_hierarchy", f"WITH r AS ({_RAW.format(n='')}), t AS (SELECT book_id, place, concat('tag-', parent[6:]) AS parent, child[1:5] AS child FROM r) SELECT book_id, parent, child, min(place) AS place FROM t WHERE parent <> child AND parent <> 'tag-4' AND child <> 'tag-4' GROUP BY 1, 2, 3")
def tag_hierarchy(spark, d):
    raw = _read(spark, d, "lineitem").selectExpr("l_orderkey AS book_id", "l_partkey * 1000 + l_linenumber * 100 + l_suppkey AS place", "concat(' Tag_', l_suppkey % 5) AS parent", "concat('tag-', l_linenumber % 5, '!') AS child")
    tags = raw.select("book_id").distinct().select("book_id", F.explode(F.array(*[F.lit(f"TAG_{i}") for i in range(4)])).alias("tag"))
    return I.tag_pairs(raw, tags, "book_id")


_WARN = "SELECT l_orderkey AS book_id, l_partkey * 1000 + l_linenumber * 100 + l_suppkey AS place, CASE l_linenumber WHEN 1 THEN ' Self Harm' WHEN 2 THEN 'WAR' WHEN 3 THEN 'mildew' WHEN 4 THEN 'self_harm' ELSE 'grief ' END AS label, CASE l_returnflag WHEN 'A' THEN 'Mild' WHEN 'N' THEN ' graphic ' ELSE 'awful' END AS severity FROM lineitem"


@query("content_warnings", f"WITH w AS (SELECT book_id, place, replace(lower(trim(label)), ' ', '_') AS label, lower(trim(severity)) AS severity FROM ({_WARN})) SELECT book_id, label, arg_min(severity, place) AS severity FROM w WHERE label IN ('self_harm', 'war', 'grief') AND severity IN ('mild', 'graphic') GROUP BY 1, 2")
def content_warnings(spark, d):
    label = F.expr("CASE l_linenumber WHEN 1 THEN ' Self Harm' WHEN 2 THEN 'WAR' WHEN 3 THEN 'mildew' WHEN 4 THEN 'self_harm' ELSE 'grief ' END")
    raw = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.expr("l_partkey * 1000 + l_linenumber * 100 + l_suppkey").alias("place"), label.alias("label"), F.expr("CASE l_returnflag WHEN 'A' THEN 'Mild' WHEN 'N' THEN ' graphic ' ELSE 'awful' END").alias("severity"))
    return I.warnings(raw, "book_id")


@query("valid_replies", "SELECT conv_id, (conv_id % 3 <> 2) AND list(turn ORDER BY turn) = range(1, count(*) + 1) AS valid FROM (SELECT conv_id, CAST(turn + conv_id % 2 AS BIGINT) AS turn FROM conversations) GROUP BY conv_id")
def valid_replies(spark, d):
    rows = _read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list((F.col("turn") + F.col("conv_id") % 2).cast("int"))).alias("steps"))
    language = F.expr("CASE conv_id % 3 WHEN 0 THEN 'EN-us' WHEN 1 THEN 'en' ELSE 'de' END")
    return rows.select("conv_id", I.valid_reply(language, F.lit("en-GB"), F.col("steps")).alias("valid"))


@query("synced_progress", """WITH p AS (SELECT o_orderkey AS book_id, CAST(floor(o_totalprice) AS BIGINT) AS position_ms, o_orderstatus = 'F' AS is_finished, o_orderdate AS synced_at FROM orders),
r AS (SELECT l_orderkey AS book_id, arg_max(CAST(l_quantity AS BIGINT), i) AS p, arg_max(l_linestatus = 'O', i) AS f FROM (SELECT *, l_partkey * 1000 + l_linenumber * 100 + l_suppkey AS i FROM lineitem) GROUP BY 1)
SELECT coalesce(p.book_id, r.book_id) AS book_id, CASE WHEN t THEN p ELSE position_ms END AS position_ms, CASE WHEN t THEN f ELSE is_finished END AS is_finished, CASE WHEN t THEN TIMESTAMP '1998-01-01' ELSE synced_at END AS synced_at
FROM (SELECT p.book_id, p.position_ms, p.is_finished, p.synced_at, r.book_id AS rb, r.p, r.f, r.book_id IS NOT NULL AND (synced_at IS NULL OR synced_at <= TIMESTAMP '1998-01-01') AS t FROM p FULL JOIN r ON p.book_id = r.book_id) x, LATERAL (SELECT x.book_id) p, LATERAL (SELECT x.rb AS book_id) r""")
def synced_progress(spark, d):
    progress = _read(spark, d, "orders").selectExpr("o_orderkey AS book_id", "CAST(floor(o_totalprice) AS BIGINT) AS position_ms", "o_orderstatus = 'F' AS is_finished", "o_orderdate AS synced_at")
    requests = _read(spark, d, "lineitem").selectExpr("l_orderkey AS book_id", "l_partkey * 1000 + l_linenumber * 100 + l_suppkey AS request_id", "CAST(l_quantity AS BIGINT) AS position_ms", "l_linestatus = 'O' AS is_finished")
    return S.synced(progress, requests, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))


@query("status_effects", with_("books") + """, p AS (SELECT o_orderkey AS book_id, o_orderstatus = 'F' AS is_finished FROM orders)
SELECT p.book_id, CASE reading_status WHEN 'finished' THEN true WHEN 'reading' THEN false ELSE is_finished END AS is_finished FROM p LEFT JOIN books b ON b.book_id = p.book_id
UNION ALL SELECT book_id, true FROM books WHERE reading_status = 'finished' AND book_id NOT IN (SELECT book_id FROM p)""")
def status_effects(spark, d):
    return S.status_effects(frame(spark, d, "books"), _read(spark, d, "orders").selectExpr("o_orderkey AS book_id", "o_orderstatus = 'F' AS is_finished"))


@query("retry_after", """SELECT event_id, CASE WHEN count(*) OVER w > 2 THEN greatest(1, CAST(ceil((epoch_us(min(ts) OVER w) + 3600000000 - epoch_us(ts)) / 1000000.0) AS BIGINT)) END AS retry_after
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")
def retry_after(spark, d):
    return S.retry_after(_read(spark, d, "events"), "user_id", "ts", 2, 3600).select("event_id", "retry_after")


_STAGE = "CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END"


@query("stage_states", f"SELECT user_id AS book_id, event_id % 3 AS stage, arg_max({_STAGE}, struct_pack(a := ts, b := event_id)) AS status, max(ts) FILTER (event_type = 'view') AS started_at, count_if(event_type = 'view') AS tries FROM events GROUP BY 1, 2")
def stage_states(spark, d):
    return S.stage_states(_read(spark, d, "events").select(F.col("user_id").alias("book_id"), (F.col("event_id") % 3).alias("stage"), F.expr(_STAGE).alias("status"), F.col("ts").alias("at"), "event_id"))


_JOURNAL = "SELECT event_id AS op_id, event_type AS op_kind, 'book' AS target_kind, user_id AS target_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('b', CAST(event_id % 50 AS VARCHAR(9))) END AS batch_id, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'pending' END AS progress FROM events"


def _journal(spark, d):
    return _read(spark, d, "events").selectExpr("event_id AS op_id", "event_type AS op_kind", "'book' AS target_kind", "user_id AS target_id", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('b', event_id % 50) END AS batch_id", "CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'pending' END AS progress")


@query("pending_batches", f"SELECT batch_id, string_agg(CAST(op_id AS VARCHAR), ',' ORDER BY op_id) AS op_ids FROM ({_JOURNAL}) WHERE progress = 'pending' GROUP BY batch_id")
def pending_batches(spark, d):
    return S.pending_batches(_journal(spark, d)).select("batch_id", F.array_join(F.col("op_ids").cast("array<string>"), ",").alias("op_ids"))


@query("pending_kinds", f"SELECT op_kind, count(*) AS n FROM ({_JOURNAL}) WHERE progress = 'pending' GROUP BY op_kind")
def pending_kinds(spark, d):
    return _journal(spark, d).where("progress = 'pending'").groupBy("op_kind").agg(F.count("*").alias("n"))


@query("journal_list", f"SELECT op_id, op_kind, target_id, batch_id, progress FROM ({_JOURNAL}) WHERE op_kind = 'view' AND progress = 'pending' ORDER BY op_id DESC LIMIT 200 OFFSET 3")
def journal_list(spark, d):
    return S.journal_list(_journal(spark, d), kind="view", progress="pending", limit=999, offset=3).select("op_id", "op_kind", "target_id", "batch_id", "progress")


@query("nested_diff", """WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS a, CAST(lead(json_extract(props, '$.k')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS b FROM events)
SELECT event_id, 'in.k.v' AS path, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS kind, CAST(a AS VARCHAR) AS before, CAST(b AS VARCHAR) AS after FROM e WHERE a IS DISTINCT FROM b
UNION ALL SELECT event_id, 'kind', 'changed', concat('"', event_type, '"'), '["x",{"y":1}]' FROM e
UNION ALL SELECT event_id, 'gone', 'removed', '{"z":1}', NULL FROM e""")
def nested_diff(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k")
    e = _read(spark, d, "events").select("event_id", "event_type", k.alias("a"), F.lead(k).over(w).alias("b"))
    text = lambda c, kind: F.concat(F.lit('{"same":[1,2],"in":{"k":{"v":'), F.coalesce(c, F.lit("null")), F.lit('}},"kind":'), kind, F.lit("}"))
    pre = F.concat(F.lit('{"gone":{"z":1},'), F.substring(text("a", F.concat(F.lit('"'), "event_type", F.lit('"'))), F.lit(2), F.lit(10_000)))
    rows = e.select("event_id", pre.alias("pre"), text("b", F.lit('["x",{"y":1}]')).alias("post"))
    return S.nested_diff(rows, "event_id", "pre", "post")


@query("fresh_caches", with_("books", "candidates") + "SELECT book_id, EXISTS (SELECT 1 FROM candidates c WHERE c.book_id = b.book_id AND c.source = 'cue' AND c.field = 'A') AS fresh FROM books b")
def fresh_caches(spark, d):
    cache = frame(spark, d, "candidates").select("book_id", F.col("source").alias("version"), F.col("field").alias("locale"))
    return S.fresh(frame(spark, d, "books").select("book_id"), cache, "cue", "A")


@query("stage_reset", "WITH a AS (SELECT DISTINCT user_id AS book_id, event_id % 97 AS stage FROM events WHERE event_type = 'error') SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.book_id = e.user_id AND a.stage = e.event_id % 97)")
def stage_reset(spark, d):
    e = _read(spark, d, "events").select("event_id", "event_type", F.col("user_id").alias("book_id"), (F.col("event_id") % 97).alias("stage"))
    return S.reset(e, e, e, e.where("event_type = 'error'"))[0].select("event_id")


@query("stale_rows", with_("candidates") + "SELECT candidate_id, book_id FROM candidates WHERE recorded_at < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY")
def stale_rows(spark, d):
    return S.stale(frame(spark, d, "candidates"), "recorded_at", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).select("candidate_id", "book_id")


@query("soft_delete", with_("books") + "SELECT book_id, CASE WHEN book_id IN (SELECT l_orderkey FROM lineitem) THEN coalesce(deleted_at, TIMESTAMP '2025-01-01') ELSE deleted_at END AS deleted_at FROM books")
def soft_delete(spark, d):
    gone = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_id"))
    return S.deleted(frame(spark, d, "books"), gone, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")).select("book_id", "deleted_at")


@query("field_changes", with_("books") + """SELECT book_id, 'title' AS field, title AS before, CASE WHEN book_id % 3 = 0 THEN NULL ELSE upper(title) END AS after FROM books WHERE CASE WHEN book_id % 3 = 0 THEN NULL ELSE upper(title) END IS DISTINCT FROM title
UNION ALL SELECT book_id, 'language', language, 'en' FROM books WHERE language IS DISTINCT FROM 'en'""")
def field_changes(spark, d):
    books = frame(spark, d, "books")
    patch = books.select("book_id", F.expr("CASE WHEN book_id % 3 = 0 THEN '  ' ELSE upper(title) END").alias("title"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("subtitle"))
    return S.field_changes(books, patch, "book_id", ["title", "language", "subtitle"])


@query("finished_since", with_("books") + "SELECT count(*) AS finished_since FROM books WHERE deleted_at IS NULL AND book_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01')")
def finished_since(spark, d):
    progress = _read(spark, d, "orders").selectExpr("o_orderkey AS book_id", "o_orderstatus = 'F' AS is_finished", "o_orderdate AS last_listened_at")
    return facets.finished_since(frame(spark, d, "books"), progress, F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))


_MEMBERS = "m AS (SELECT l_partkey AS book_id, l_suppkey AS collection_id, l_shipdate AS added_at, l_orderkey * 10 + l_linenumber AS member_id FROM lineitem)"


def _members(spark, d):
    return _read(spark, d, "lineitem").selectExpr("l_partkey AS book_id", "l_suppkey AS collection_id", "l_shipdate AS added_at", "l_orderkey * 10 + l_linenumber AS member_id")


@query("facet_collection", with_("books", "authors") + f""", {_MEMBERS}, g AS (SELECT c.author_id AS key, coalesce(name, 'none') AS label, count(*) AS count FROM books b LEFT JOIN m ON m.book_id = b.book_id LEFT JOIN authors c ON c.author_id = m.collection_id WHERE deleted_at IS NULL GROUP BY 1, 2),
r AS (SELECT *, least(row_number() OVER (ORDER BY count DESC, label NULLS LAST, key), 21) AS slot FROM g), s AS (SELECT CASE WHEN slot = 21 THEN 'Others' ELSE min(label) END AS label, CAST(sum(count) AS BIGINT) AS count FROM r GROUP BY slot)
SELECT label, count, round(count * 100.0 / sum(count) OVER (), 4) AS percentage FROM s""")
def facet_collection(spark, d):
    names = frame(spark, d, "authors").select(F.col("author_id").alias("collection_id"), "name")
    rows = frame(spark, d, "books").where("deleted_at IS NULL").select("book_id").join(_members(spark, d), "book_id", "left").join(names, "collection_id", "left")
    return facets.breakdown(rows, F.coalesce("name", F.lit("none")), F.when(F.col("name").isNotNull(), F.col("collection_id")))


@query("book_collections", with_("authors") + f", {_MEMBERS} SELECT book_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS collections FROM m JOIN authors a ON a.author_id = m.collection_id GROUP BY book_id")
def book_collections(spark, d):
    names = frame(spark, d, "authors").select(F.col("author_id").alias("collection_id"), "name")
    return C.joined_names(_members(spark, d).join(names, "collection_id"), "book_id", "name", "collections")


@query("primary_collection", f"WITH {_MEMBERS} SELECT book_id, arg_min(collection_id, struct_pack(a := added_at, b := member_id, c := collection_id)) AS collection_id FROM m GROUP BY book_id")
def primary_collection(spark, d):
    return _members(spark, d).groupBy("book_id").agg(F.min_by("collection_id", F.struct("added_at", "member_id", "collection_id")).alias("collection_id"))


@query("author_detail", with_("books", "authors", "author_aliases") + "SELECT a.author_id, name, (SELECT count(*) FROM books b WHERE b.author_id = a.author_id) AS book_count, coalesce((SELECT string_agg(alias, '; ' ORDER BY alias) FROM author_aliases x WHERE x.author_id = a.author_id), '') AS aliases FROM authors a")
def author_detail(spark, d):
    aliases = frame(spark, d, "author_aliases").groupBy("author_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), "; ").alias("aliases"))
    counted = C.entity_list(frame(spark, d, "authors"), frame(spark, d, "books").select("author_id"), "author_id")
    return counted.join(aliases, "author_id", "left").withColumn("aliases", F.coalesce("aliases", F.lit("")))


@query("chapter_sources", with_("candidates") + "SELECT book_id, source, count(*) AS n FROM candidates GROUP BY book_id, source")
def chapter_sources(spark, d):
    return frame(spark, d, "candidates").groupBy("book_id", "source").agg(F.count("*").alias("n"))


@query("cache_bytes", "SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes, sum(strlen(text)) > 5368709120 AS over FROM documents")
def cache_bytes(spark, d):
    return _read(spark, d, "documents").agg(F.sum(F.octet_length("text")).alias("bytes")).withColumn("over", F.col("bytes") > 5 * 1024**3)


@query("mean_confidence", with_("candidates", "books") + "SELECT b.book_id, coalesce((SELECT round(avg(confidence), 6) FROM candidates c WHERE c.book_id = b.book_id), 0) AS mean FROM books b")
def mean_confidence(spark, d):
    mean = frame(spark, d, "candidates").groupBy("book_id").agg(F.round(F.avg("confidence"), 6).alias("mean"))
    return frame(spark, d, "books").select("book_id").join(mean, "book_id", "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))


@query("output_language", "SELECT s.source, coalesce(l.lang, 'en') AS lang FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang DESC) AS r FROM documents WHERE trim(lang) <> '' AND n_chars > 5000 GROUP BY source, lang) WHERE r = 1) l ON l.source IS NOT DISTINCT FROM s.source")
def output_language(spark, d):
    docs = _read(spark, d, "documents")
    votes = docs.groupBy("source", F.when((F.trim("lang") != "") & (F.col("n_chars") > 5000), F.col("lang")).alias("lang")).agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("lang").isNotNull(), F.struct("n", "lang")))
    return votes.groupBy("source").agg(F.coalesce(best["lang"], F.lit("en")).alias("lang"))


@query("duplicate_recordings", """WITH k AS (SELECT DISTINCT l_shipdate AS a0, l_quantity AS f, l_partkey AS book_id FROM lineitem), g AS (SELECT a0, f, list_sort(list(book_id)) AS books FROM k GROUP BY 1, 2 HAVING count(*) > 1)
SELECT array_to_string(books, ',') AS books, count(*) AS agreeing FROM g GROUP BY books""")
def duplicate_recordings(spark, d):
    keys = _read(spark, d, "lineitem").select(F.col("l_shipdate").alias("at"), F.col("l_quantity").alias("f"), F.col("l_partkey").alias("book_id"))
    groups = keys.groupBy("at", "f").agg(F.array_sort(F.collect_set("book_id")).alias("books")).where(F.size("books") > 1)
    return groups.groupBy("books").agg(F.count("*").alias("agreeing")).select(F.array_join(F.col("books").cast("array<string>"), ",").alias("books"), "agreeing")


@query("seed_counts", "SELECT coalesce(nullif(trim(CASE WHEN p_size % 4 = 0 THEN '  ' ELSE p_brand END), ''), '(blank)') AS publisher, count(*) AS n FROM part GROUP BY 1")
def seed_counts(spark, d):
    name = F.expr("CASE WHEN p_size % 4 = 0 THEN '  ' ELSE p_brand END")
    return _read(spark, d, "part").groupBy(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("(blank)")).alias("publisher")).agg(F.count("*").alias("n"))


@query("paired_total", with_("books", "files") + "SELECT b.book_id, CAST(coalesce((SELECT sum(size) FROM files f WHERE f.book_id = b.book_id AND is_active), 0) AS BIGINT) AS total FROM books b")
def paired_total(spark, d):
    total = frame(spark, d, "files").where("is_active").groupBy("book_id").agg(F.sum("size").alias("total"))
    return frame(spark, d, "books").select("book_id").join(total, "book_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))


@query("series_by_state", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderpriority, o_orderkey) AS INTEGER) AS place FROM orders ORDER BY 2 LIMIT 200")
def series_by_state(spark, d):
    from pyspark.sql.window import Window

    state = F.expr("CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END")
    page = _read(spark, d, "orders").orderBy(state, "o_orderpriority", "o_orderkey").limit(S.page_rows(500)).withColumn("state", state)
    return page.select("o_orderkey", F.row_number().over(Window.orderBy("state", "o_orderpriority", "o_orderkey")).alias("place"))  # over the rows of one page


@query("entities_by_name", with_("authors") + "SELECT author_id, name FROM authors ORDER BY lower(name), author_id LIMIT 50")
def entities_by_name(spark, d):
    return frame(spark, d, "authors").orderBy(F.lower("name"), "author_id").limit(S.page_rows(None))


@query("saved_queries", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS pin FROM customer ORDER BY pin IS NULL, pin, c_custkey LIMIT 200")
def saved_queries(spark, d):
    rows = _read(spark, d, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END").alias("pin"))
    return rows.orderBy(F.col("pin").asc_nulls_last(), "c_custkey").limit(S.page_rows(1000))


@query("resolved_transcripts", "SELECT doc_id, CASE WHEN trim(source) <> '' AND doc_id % 2 = 0 THEN source ELSE coalesce(text, '') END AS said FROM documents")
def resolved_transcripts(spark, d):
    better = F.when(F.col("doc_id") % 2 == 0, F.nullif(F.trim("source"), F.lit("")))
    return _read(spark, d, "documents").select("doc_id", F.coalesce(F.when(better.isNotNull(), F.col("source")), "text", F.lit("")).alias("said"))


@query("snippets", """WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM documents),
h AS (SELECT *, list_transform(t, lambda x: lower(regexp_replace(regexp_replace(x, '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', '')) IN ('the', 'der')) AS h FROM t), p AS (SELECT *, list_position(h, true) AS p0 FROM h),
f AS (SELECT *, greatest(1, least(p0 - 8, len(t) - 15)) AS f FROM p WHERE p0 > 0)
SELECT doc_id, concat(CASE WHEN f > 1 THEN '…' ELSE '' END, array_to_string(list_transform(range(f, least(f + 16, len(t) + 1)), lambda i: CASE WHEN h[i] THEN concat('[match]', t[i], '[/match]') ELSE t[i] END), ' '), CASE WHEN f + 16 <= len(t) THEN '…' ELSE '' END) AS shown FROM f""")
def snippets(spark, d):
    return _read(spark, d, "documents").select("doc_id", X.snippet(F.col("text"), ["the", "der"]).alias("shown")).where("shown IS NOT NULL")


@query("search_series", with_("series", "book_series") + "SELECT s.series_id, name, (SELECT count(*) FROM book_series b WHERE b.series_id = s.series_id) AS book_count FROM series s WHERE contains(lower(name), 'saga')")
def search_series(spark, d):
    return C.entity_list(X.substring_match(frame(spark, d, "series"), ["name"], "SAGA"), frame(spark, d, "book_series").select("series_id"), "series_id")


@query("search_narrators", with_("authors", "book_narrator") + "SELECT a.author_id AS narrator_id, name, (SELECT count(DISTINCT book_id) FROM book_narrator b WHERE b.narrator_id = a.author_id) AS book_count FROM authors a WHERE contains(lower(name), '0001')")
def search_narrators(spark, d):
    names = frame(spark, d, "authors").select(F.col("author_id").alias("narrator_id"), "name")
    return C.entity_list(X.substring_match(names, ["name"], "0001"), frame(spark, d, "book_narrator").select("narrator_id", "book_id").distinct(), "narrator_id")


@query("longest_roots", """WITH p AS (SELECT o_orderkey AS path_id, concat('/m/', CAST(o_custkey AS VARCHAR), '/', o_orderstatus, '/', CAST(o_orderkey AS VARCHAR)) AS path FROM orders), r AS (SELECT concat('/m/', CAST(c_custkey AS VARCHAR)) AS root FROM customer UNION SELECT concat('/m/', CAST(c_custkey AS VARCHAR), '/F') FROM customer UNION SELECT '/m')
SELECT path_id, (SELECT arg_max(root, length(root)) FROM r WHERE p.path = r.root OR starts_with(p.path, concat(r.root, '/'))) AS root FROM p""")
def longest_roots(spark, d):
    paths = _read(spark, d, "orders").selectExpr("o_orderkey AS path_id", "concat('/m/', o_custkey, '/', o_orderstatus, '/', o_orderkey) AS path")
    customers = _read(spark, d, "customer")
    roots = customers.selectExpr("explode(array(concat('/m/', c_custkey), concat('/m/', c_custkey, '/F'), '/m')) AS root")
    return S.longest_roots(paths, roots).select("path_id", "root")


@query("tag_winners", "SELECT l_orderkey AS book_id, CASE l_returnflag WHEN 'A' THEN 'title' ELSE 'asin' END AS field, l_linestatus AS value FROM lineitem WHERE l_returnflag <> 'R' AND l_discount > 0.05")
def tag_winners(spark, d):
    rows = _read(spark, d, "lineitem").selectExpr("l_orderkey AS book_id", "CASE l_returnflag WHEN 'A' THEN 'title' WHEN 'N' THEN 'asin' ELSE 'mood' END AS field", "l_linestatus AS value", "l_discount > 0.05 AS is_winner")
    return S.tag_winners(rows)


@query("confirmed_signatures", "SELECT p_partkey, p_size % 2 = 0 AND p_size >= 5 AS confirmed FROM part")
def confirmed_signatures(spark, d):
    rows = _read(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_size % 2 = 0 THEN 'silence' END AS verified_via", "p_size AS match_count")
    return S.confirmed(rows).select("p_partkey", "confirmed")


@query("prestripped_books", with_("books") + "SELECT book_id FROM books WHERE audiologo_status <> 'applied' AND book_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND book_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def prestripped_books(spark, d):
    books = frame(spark, d, "books").where("audiologo_status <> 'applied'").select("book_id")
    coverage = _read(spark, d, "orders").selectExpr("o_orderkey AS book_id", "CASE WHEN o_orderstatus = 'F' THEN 'PreStripped' ELSE 'Full' END AS coverage")
    return S.prestripped(books, _read(spark, d, "events").where("event_type = 'error'").selectExpr("user_id AS book_id", "'candidate' AS status"), coverage)
