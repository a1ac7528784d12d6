"""Consensus, identity, timeline and state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import scalar as N
from lectern.operators import consensus as K
from lectern.operators import state as S
from lectern.operators import timeline as T
from lectern.plans.standins import checkpoint_folder, frame, with_

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def best():
    return [F.desc("confidence"), F.desc("recorded_at"), F.desc("candidate_id")]


_BEST = "confidence DESC, recorded_at DESC, candidate_id DESC"


@query("consensus_winner", with_("candidates") + f"SELECT book_id, field, value, confidence, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY book_id, field ORDER BY {_BEST}) AS r FROM candidates WHERE value IS NOT NULL) WHERE r = 1")
def consensus_winner(spark, d):
    return K.winners(frame(spark, d, "candidates"), ["book_id", "field"], best()).select("book_id", "field", "value", "confidence", "candidate_id")


@query("consensus_values", with_("candidates") + "SELECT book_id, value, max(confidence) AS confidence, arg_max(candidate_id, struct_pack(a := confidence, b := recorded_at, c := candidate_id)) AS candidate_id FROM candidates GROUP BY book_id, value")
def consensus_values(spark, d):
    return K.best_values(frame(spark, d, "candidates"), ["book_id"]).select("book_id", "value", "confidence", "candidate_id")


@query("consensus_conflicts", with_("candidates") + "SELECT book_id, field, count(DISTINCT value) AS n FROM candidates GROUP BY book_id, field HAVING count(DISTINCT value) > 1")
def consensus_conflicts(spark, d):
    return frame(spark, d, "candidates").groupBy("book_id", "field").agg(F.count_distinct("value").alias("n")).where("n > 1")


@query("retention_drop", with_("candidates") + f"SELECT candidate_id, book_id, field FROM (SELECT *, row_number() OVER (PARTITION BY book_id, field ORDER BY recorded_at DESC, candidate_id DESC) AS r FROM candidates) WHERE (r = 1 AND recorded_at < TIMESTAMP '1996-01-01') OR (r > 1 AND recorded_at < TIMESTAMP '1997-01-01')")
def retention_drop(spark, d):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = K.retention(frame(spark, d, "candidates"), ["book_id", "field"], best()[1:], F.col("recorded_at"), at("1996-01-01"), at("1997-01-01"))
    return rows.select("candidate_id", "book_id", "field")


@query("chapter_source", with_("candidates") + "SELECT book_id, CASE min(CASE source WHEN 'catalog' THEN 1 WHEN 'embedded' THEN 2 WHEN 'cue' THEN 3 END) WHEN 1 THEN 'catalog' WHEN 2 THEN 'embedded' ELSE 'cue' END AS winner FROM candidates WHERE source IN ('catalog', 'embedded', 'cue') GROUP BY book_id")
def chapter_source(spark, d):
    return K.by_precedence(frame(spark, d, "candidates"), "book_id", "source", ["catalog", "embedded", "cue", "epub", "transcript", "silence"])


@query("distinct_values", with_("candidates") + f"SELECT book_id, value, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY book_id, lower(trim(value)) ORDER BY {_BEST}) AS r FROM candidates WHERE trim(value) <> '') WHERE r = 1")
def distinct_values(spark, d):
    return K.distinct_values(frame(spark, d, "candidates"), "book_id").select("book_id", "value", "candidate_id")


@query("series_resolve", with_("candidates") + """, c AS (SELECT book_id, field AS name, CASE WHEN candidate_id % 3 = 0 THEN NULL WHEN candidate_id % 3 = 1 THEN '' ELSE concat('B', CAST(candidate_id AS VARCHAR)) END AS asin,
  CASE WHEN candidate_id % 2 = 0 THEN CAST(candidate_id % 10 AS DOUBLE) END AS position, candidate_id % 5 = 0 AS is_primary, confidence, candidate_id FROM candidates)
SELECT book_id, lower(trim(name)) AS series_key, arg_min(trim(name), struct_pack(a := -confidence, b := candidate_id)) AS name, arg_min(asin, struct_pack(a := -confidence, b := candidate_id)) FILTER (coalesce(asin, '') <> '') AS asin,
  arg_min(position, struct_pack(a := -confidence, b := candidate_id)) FILTER (position IS NOT NULL) AS position, bool_or(is_primary) AS is_primary FROM c GROUP BY book_id, lower(trim(name))""")
def series_resolve(spark, d):
    c = frame(spark, d, "candidates").selectExpr(
        "book_id", "field AS name", "CASE WHEN candidate_id % 3 = 0 THEN NULL WHEN candidate_id % 3 = 1 THEN '' ELSE concat('B', candidate_id) END AS asin",
        "CASE WHEN candidate_id % 2 = 0 THEN CAST(candidate_id % 10 AS DOUBLE) END AS position", "candidate_id % 5 = 0 AS is_primary", "confidence", "candidate_id")
    return K.series_groups(c)


@query("resolve_entities", with_("books", "authors") + """, k AS (SELECT author_id AS entity_id, name AS alias, CASE WHEN author_id % 4 = 0 THEN concat('X', CAST(author_id AS VARCHAR)) END AS external_id FROM authors
  UNION ALL SELECT author_id, concat('Pen ', CAST(author_id % 5 AS VARCHAR)), NULL FROM authors),
n AS (SELECT book_id AS row_id, CASE WHEN book_id % 3 = 0 THEN concat('pen ', CAST(book_id % 7 AS VARCHAR)) ELSE upper((SELECT name FROM authors a WHERE a.author_id = b.author_id)) END AS name, CASE WHEN book_id % 10 = 0 THEN concat('X', CAST(author_id AS VARCHAR)) END AS external_id FROM books b),
i AS (SELECT external_id, min(entity_id) AS by_id FROM k WHERE external_id IS NOT NULL GROUP BY 1), a AS (SELECT lower(trim(alias)) AS key, count(DISTINCT entity_id) AS n, min(entity_id) AS e FROM k GROUP BY 1)
SELECT row_id, name, CASE WHEN by_id IS NOT NULL THEN 'external' WHEN n = 1 THEN 'alias' WHEN n > 1 THEN 'ambiguous' ELSE 'new' END AS outcome, coalesce(by_id, CASE WHEN n = 1 THEN e END) AS entity_id
FROM n LEFT JOIN i USING (external_id) LEFT JOIN a ON a.key = lower(trim(n.name))""")
def resolve_entities(spark, d):
    authors = frame(spark, d, "authors")
    known = authors.selectExpr("author_id AS entity_id", "name AS alias", "CASE WHEN author_id % 4 = 0 THEN concat('X', author_id) END AS external_id").unionByName(
        authors.selectExpr("author_id AS entity_id", "concat('Pen ', author_id % 5) AS alias", "CAST(NULL AS STRING) AS external_id"))
    names = frame(spark, d, "books").join(authors, "author_id", "left").selectExpr(
        "book_id AS row_id", "CASE WHEN book_id % 3 = 0 THEN concat('pen ', book_id % 7) ELSE upper(name) END AS name", "CASE WHEN book_id % 10 = 0 THEN concat('X', author_id) END AS external_id")
    return K.resolved(names, known)


_SCORES = "SELECT l_orderkey AS book_id, l_suppkey AS entity_id, round(max(l_discount) * 10, 1) AS score FROM lineitem GROUP BY 1, 2"


@query("corroborate", f"WITH s AS ({_SCORES}), r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY book_id ORDER BY score DESC, entity_id)) SELECT book_id, entity_id, score FROM r WHERE rank = 1 AND (next IS NULL OR score - next > 0.3)")
def corroborate(spark, d):
    scores = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("book_id"), F.col("l_suppkey").alias("entity_id")).agg(F.round(F.max("l_discount") * 10, 1).alias("score"))
    return K.corroborated(scores, "book_id")


@query("series_gaps", with_("book_series") + """, w AS (SELECT series_id, position, abs(position - round(position)) < 1e-6 AS whole FROM book_series),
b AS (SELECT series_id, min(position) FILTER (whole) AS lo, max(position) FILTER (whole) AS hi, count(DISTINCT position) FILTER (whole) AS n, list(DISTINCT CAST(position AS BIGINT)) FILTER (whole) AS have,
  list_sort(coalesce(list(DISTINCT position) FILTER (NOT whole), [])) AS fractional FROM w GROUP BY series_id)
SELECT series_id, CASE WHEN n >= 2 THEN array_to_string(list_filter(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1), lambda x: NOT list_contains(have, x)), ',') ELSE '' END AS missing, array_to_string(fractional, ',') AS fractional FROM b""")
def series_gaps(spark, d):
    rows = K.series_gaps(frame(spark, d, "book_series"), "series_id")
    return rows.select("series_id", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"), F.array_join(F.col("fractional").cast("array<string>"), ",").alias("fractional"))


@query("franchise_prefix")
def franchise_prefix(spark, d):
    titles = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey AS series_id", "concat('Saga ', o_custkey % 7, ': ', o_orderpriority, ' vol ', o_orderkey) AS title")
    return K.franchise_prefix(titles, "series_id")


ORACLES["franchise_prefix"] = """WITH t AS (SELECT o_custkey AS series_id, concat('Saga ', CAST(o_custkey % 7 AS VARCHAR), ': ', o_orderpriority, ' vol ', CAST(o_orderkey AS VARCHAR)) AS title FROM orders)
SELECT series_id, concat('Saga ', CAST(series_id % 7 AS VARCHAR), ': ') AS prefix FROM t GROUP BY series_id HAVING count(*) >= 2"""


@query("hierarchy_descendants", "WITH RECURSIVE e AS (SELECT n_nationkey AS child, n_regionkey AS parent FROM nation), r AS (SELECT parent AS ancestor, child AS node FROM e UNION SELECT r.ancestor, e.child FROM r JOIN e ON r.node = e.parent) SELECT * FROM r")
def hierarchy_descendants(spark, d):
    checkpoint_folder(spark)
    return K.descendants(spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_regionkey AS parent", "n_nationkey AS child"))


@query("hierarchy_deep", "WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer), r AS (SELECT parent AS ancestor, child AS node FROM e UNION SELECT r.ancestor, e.child FROM r JOIN e ON r.node = e.parent) SELECT * FROM r")
def hierarchy_deep(spark, d):
    checkpoint_folder(spark)
    return K.descendants(spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey div 3 AS parent", "c_custkey AS child"))


_STATED = "SELECT concat(o_orderpriority, o_orderstatus) AS series_id, concat(CASE WHEN o_orderpriority < '3' THEN 'Saga - ' ELSE '' END, CASE o_orderstatus WHEN 'F' THEN 'Part ' ELSE 'The : ' END, CAST(o_orderkey AS VARCHAR(19))) AS title FROM orders"


@query("franchise_computed", f"""WITH e AS (SELECT series_id, min(title) AS a, max(title) AS b FROM ({_STATED}) GROUP BY series_id HAVING count(*) >= 2),
p AS (SELECT series_id, a[1:list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: starts_with(b, a[1:i])))] AS p FROM e),
c AS (SELECT series_id, CASE WHEN contains(p, ': ') THEN p[1:length(p) - instr(reverse(p), ' :') + 1] WHEN contains(p, ' - ') THEN p[1:length(p) - instr(reverse(p), ' - ') + 1] END AS c FROM p)
SELECT series_id, CASE WHEN strlen(c) >= 4 THEN c END AS prefix FROM c""")
def franchise_computed(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    case = "concat(CASE WHEN o_orderpriority < '3' THEN 'Saga - ' ELSE '' END, CASE o_orderstatus WHEN 'F' THEN 'Part ' ELSE 'The : ' END, o_orderkey)"
    return K.franchise_prefix(orders.selectExpr("concat(o_orderpriority, o_orderstatus) AS series_id", f"{case} AS title"), "series_id")


@query("owned_annotation", "SELECT o_orderkey AS product_id, CASE WHEN c_custkey IS NOT NULL THEN 'Owned' WHEN o_orderdate > TIMESTAMP '1997-01-01' THEN 'PreOrder' ELSE 'New' END AS state FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey")
def owned_annotation(spark, d):
    owned = spark.read.parquet(f"{d}/customer.parquet").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    rows = spark.read.parquet(f"{d}/orders.parquet").join(owned, F.col("o_custkey") == F.col("c_custkey"), "left")
    late = F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp_ntz")
    return rows.select(F.col("o_orderkey").alias("product_id"), F.when(F.col("c_custkey").isNotNull(), "Owned").when(late, "PreOrder").otherwise("New").alias("state"))


_OFF = with_("files") + ", f AS (SELECT *, coalesce(sum(greatest(coalesce(duration_ms, 0), 0)) OVER (PARTITION BY book_id ORDER BY file_id, duration_ms NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms FROM files), o AS (SELECT *, start_ms + greatest(coalesce(duration_ms, 0), 0) AS end_ms FROM f) "


def _offsets(spark, d):
    return T.offsets(frame(spark, d, "files"), "book_id", ["file_id", "duration_ms"], "duration_ms")


@query("file_offsets", _OFF + "SELECT book_id, file_id, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms FROM o")
def file_offsets(spark, d):
    return _offsets(spark, d).select("book_id", "file_id", "start_ms", "end_ms")


@query("position_file", _OFF + ", t AS (SELECT book_id, book_id % 40 * 120000 AS at_ms FROM (SELECT DISTINCT book_id FROM files)) SELECT t.book_id, at_ms, file_id, CAST(at_ms - start_ms AS BIGINT) AS in_file_ms FROM t LEFT JOIN o ON o.book_id = t.book_id AND at_ms >= start_ms AND at_ms < end_ms")
def position_file(spark, d):
    targets = frame(spark, d, "files").select("book_id").distinct().selectExpr("book_id", "book_id % 40 * 120000 AS at_ms")
    return T.position_file(_offsets(spark, d), targets, "book_id")


_CH = with_("chapters") + ", c AS (SELECT *, CAST(coalesce(sum(length_ms) OVER (PARTITION BY book_id ORDER BY idx, length_ms, title ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM chapters) "


def _chapters(spark, d):
    rows = T.offsets(frame(spark, d, "chapters"), "book_id", ["idx", "length_ms", "title"], "length_ms")
    return rows


@query("chapter_ends", _CH + "SELECT book_id, idx, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY book_id ORDER BY start_ms, idx), greatest(start_ms, 100000)) AS end_ms FROM c")
def chapter_ends(spark, d):
    rows = _chapters(spark, d).drop("end_ms").withColumn("file_end", F.lit(100000))
    return T.chapter_ends(rows, "book_id", "start_ms", "file_end").select("book_id", "idx", "start_ms", "end_ms")


@query("chapter_cut", _CH + ", e AS (SELECT *, start_ms + length_ms AS end_ms FROM c) SELECT book_id, idx, CASE WHEN start_ms >= 15000 THEN start_ms - 4000 ELSE start_ms END AS start_ms, CASE WHEN start_ms >= 15000 OR (start_ms < 10000 AND end_ms > 15000) THEN end_ms - 4000 ELSE end_ms END AS end_ms FROM e")
def chapter_cut(spark, d):
    return T.shift_for_cut(_chapters(spark, d), F.lit(10000), F.lit(15000), F.lit(1000)).select("book_id", "idx", "start_ms", "end_ms")


@query("chapter_coverage", with_("chapters") + "SELECT book_id, CASE WHEN abs(sum(length_ms) - max(length_ms * idx)) <= 1500 THEN 'Full' WHEN abs(sum(length_ms) - 5000 - max(length_ms * idx)) <= 1500 THEN 'PreStripped' ELSE 'Ambiguous' END AS coverage FROM chapters GROUP BY book_id")
def chapter_coverage(spark, d):
    rows = frame(spark, d, "chapters").groupBy("book_id").agg(F.sum("length_ms").alias("total"), F.max(F.col("length_ms") * F.col("idx")).alias("last"))
    return rows.select("book_id", T.coverage(F.col("total"), F.col("last"), F.lit(5000)).alias("coverage"))


@query("running_max", with_("chapters") + "SELECT book_id, idx, title, max(length_ms) OVER (PARTITION BY book_id ORDER BY idx, title, length_ms ROWS UNBOUNDED PRECEDING) AS length_ms FROM chapters")
def running_max(spark, d):
    return T.monotone(frame(spark, d, "chapters").withColumn("own", F.col("length_ms")), "book_id", ["idx", "title", "own"], "length_ms").select("book_id", "idx", "title", "length_ms")


@query("sample_windows", with_("files") + "SELECT file_id, part, CAST(floor(secs * part) AS BIGINT) AS start_sec FROM (SELECT file_id, CAST(duration_ms AS DOUBLE) / 1000 AS secs FROM files), (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75]) AS part) WHERE secs >= 30 AND floor(secs * part) + 30 <= secs")
def sample_windows(spark, d):
    rows = frame(spark, d, "files").selectExpr("file_id", "CAST(duration_ms AS DOUBLE) / 1000 AS secs")
    return T.sample_windows(rows, "secs").select("file_id", "part", "start_sec")


def _bits(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", F.transform("embedding", lambda x: F.when(x > 0, 65535).otherwise(0).cast("long")).alias("bits"))


@query("signature_hamming", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 65535 ELSE 0 END) AS b FROM embeddings) SELECT x.vec_id, y.vec_id AS other_id, CAST(list_sum(list_transform(range(1, 65), lambda i: bit_count(xor(x.b[i], y.b[i])))) AS BIGINT) AS distance FROM e x JOIN e y ON y.vec_id = x.vec_id + 1")
def signature_hamming(spark, d):
    e = _bits(spark, d)
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("bits").alias("more"))
    return e.join(other, "vec_id").select("vec_id", "other_id", T.hamming(F.col("bits"), F.col("more")).alias("distance"))


@query("signature_slide")
def signature_slide(spark, d):
    e = _bits(spark, d)
    hay = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits").alias("hay"))
    rows = e.join(hay, "vec_id").select("vec_id", T.slide_match(F.slice("bits", 1, 8), F.col("hay")).alias("m"))
    return rows.select("vec_id", "m.distance", F.col("m.offset").alias("place"), F.round(T.confidence(F.col("m.distance"), F.lit(8)), 6).alias("confidence"))


ORACLES["signature_slide"] = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 65535 ELSE 0 END) AS b FROM embeddings),
p AS (SELECT x.vec_id, o, CAST(list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(x.b[i], y.b[i + o])))) AS BIGINT) AS distance FROM e x JOIN e y ON y.vec_id = x.vec_id + 1, (SELECT unnest(range(0, 57)) AS o)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, o) AS k FROM p)
SELECT vec_id, distance, CAST(o AS INTEGER) AS place, round(greatest(0, 1 - distance / 256.0), 6) AS confidence FROM r WHERE k = 1"""


@query("vector_cosine", "SELECT x.vec_id, y.vec_id AS other_id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def vector_cosine(spark, d):
    e = _bits(spark, d)
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("more"))
    return e.join(other, "vec_id").select("vec_id", "other_id", F.round(T.cosine(F.col("embedding"), F.col("more")), 6).alias("cosine"))


@query("proximity_pairs", "SELECT a.event_id, b.event_id AS near_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND abs(epoch_ms(a.ts) - epoch_ms(b.ts)) <= 600000")
def proximity_pairs(spark, d):
    # Times in buckets of the reach: a pair is in equal or adjacent ones, so the join is on keys.
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    b = F.floor(F.col("ms") / 600000)
    left = e.where("event_type = 'view'").select("user_id", "event_id", "ms", F.explode(F.array(b - 1, b, b + 1)).alias("bucket"))
    right = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("near_id"), F.col("ms").alias("near_ms"), b.alias("bucket"))
    return left.join(right, ["user_id", "bucket"]).where("abs(ms - near_ms) <= 600000").select("event_id", "near_id")


@query("latest_progress", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_progress(spark, d):
    return S.latest(spark.read.parquet(f"{d}/events.parquet"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("rate_limit", "SELECT event_id, user_id, count(*) OVER w AS recent, count(*) OVER w > 2 AS limited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
def rate_limit(spark, d):
    return S.limited(spark.read.parquet(f"{d}/events.parquet"), "user_id", "ts", 2, 3600).select("event_id", "user_id", "recent", "limited")


_STAGES = [("scan", None), ("tags", "scan"), ("enrich", "tags"), ("chapters", "tags"), ("publish", "enrich"), ("publish", "chapters")]
_EDGES = "(VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else repr(b)})" for a, b in _STAGES) + ") AS e(stage, requires)"
_PROGRESS = "SELECT DISTINCT l_orderkey AS book_id, CASE l_linenumber WHEN 1 THEN 'scan' WHEN 2 THEN 'tags' WHEN 3 THEN 'enrich' ELSE 'chapters' END AS stage, CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' WHEN 2 THEN 'skipped' ELSE 'succeeded' END AS status FROM lineitem WHERE l_linenumber <= 4"


@query("stage_ready", f"WITH p AS ({_PROGRESS}), e AS (SELECT * FROM {_EDGES}), b AS (SELECT DISTINCT book_id FROM p) SELECT b.book_id, e.stage FROM b, e LEFT JOIN p ON p.book_id = b.book_id AND p.stage = e.requires AND p.status IN ('succeeded', 'skipped') WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.book_id = b.book_id AND q.stage = e.stage AND q.status IN ('succeeded', 'skipped', 'running')) GROUP BY 1, 2 HAVING bool_and(e.requires IS NULL OR p.stage IS NOT NULL)")
def stage_ready(spark, d):
    progress = spark.sql(_PROGRESS.replace("FROM lineitem", "FROM {lines}"), lines=spark.read.parquet(f"{d}/lineitem.parquet"))
    edges = spark.createDataFrame(_STAGES, "stage string, requires string")
    return S.ready(edges.select("stage").distinct(), edges, progress)


@query("backoff", "SELECT l_orderkey AS task_id, l_linenumber, CAST(CASE WHEN l_linenumber < 3 THEN 600 ELSE least(600 * pow(2, l_linenumber - 2), 86400) END AS BIGINT) AS wait FROM lineitem")
def backoff(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select(F.col("l_orderkey").alias("task_id"), "l_linenumber", S.backoff(F.col("l_linenumber"), F.lit(600)).alias("wait"))


_OLD, _NEW = "SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0", "SELECT o_orderkey AS k, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 2 = 0"


def _sides(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS k", "o_totalprice AS v"), o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS k", "o_totalprice + 1 AS v")


@query("upsert_replace", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)")
def upsert_replace(spark, d):
    return S.upserted(*_sides(spark, d), ["k"])


@query("upsert_ignore", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)")
def upsert_ignore(spark, d):
    return S.upserted(*_sides(spark, d), ["k"], ignore=True)


@query("integrity_checks", with_("books", "authors", "book_series", "series", "candidates") + """SELECT 'orphan author' AS check_name, CASE WHEN count(*) = 0 THEN 'ok' ELSE 'fail' END AS status, count(*) AS n FROM books WHERE author_id NOT IN (SELECT author_id FROM authors)
UNION ALL SELECT 'orphan series', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM book_series WHERE series_id NOT IN (SELECT series_id FROM series)
UNION ALL SELECT 'duplicate candidate', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'fail' END, count(*) FROM (SELECT candidate_id FROM candidates GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'no duration', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM books WHERE duration_ms IS NULL""")
def integrity_checks(spark, d):
    books = frame(spark, d, "books")
    return (
        S.check("orphan author", books.join(frame(spark, d, "authors"), "author_id", "left_anti"))
        .unionByName(S.check("orphan series", frame(spark, d, "book_series").join(frame(spark, d, "series"), "series_id", "left_anti"), fails=False))
        .unionByName(S.check("duplicate candidate", frame(spark, d, "candidates").groupBy("candidate_id").count().where("count > 1")))
        .unionByName(S.check("no duration", books.where("duration_ms IS NULL"), fails=False))
    )


@query("eligible_files", with_("files") + "SELECT file_id FROM files f WHERE is_active AND lower(format) <> 'm4b' AND EXISTS (SELECT 1 FROM files g WHERE g.book_id = f.book_id AND g.is_active AND lower(g.format) = 'm4b') AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = f.book_id AND e.event_type = 'error')")
def eligible_files(spark, d):
    files = frame(spark, d, "files").where("is_active")
    made = files.where("lower(format) = 'm4b'").select("book_id").distinct()
    held = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").select(F.col("user_id").alias("book_id")).distinct()
    return files.where("lower(format) <> 'm4b'").join(made, "book_id", "left_semi").join(held, "book_id", "left_anti").select("file_id")


@query("status_decision", with_("candidates") + "SELECT book_id, CASE WHEN count_if(source = 'catalog') > 0 THEN 'applied' WHEN count_if(source IN ('embedded', 'cue')) > 0 THEN 'candidate' WHEN count(*) > 0 THEN 'rejected' ELSE 'none' END AS status FROM candidates GROUP BY book_id")
def status_decision(spark, d):
    n = lambda *s: F.count_if(F.col("source").isin(*s))
    return frame(spark, d, "candidates").groupBy("book_id").agg(F.when(n("catalog") > 0, "applied").when(n("embedded", "cue") > 0, "candidate").otherwise("rejected").alias("status"))


@query("duplicate_groups", """WITH d AS (SELECT doc_id, md5(text) AS h FROM documents), g AS (SELECT h, list_sort(list(DISTINCT doc_id)) AS ids FROM d GROUP BY h HAVING count(DISTINCT doc_id) > 1)
SELECT array_to_string(ids, ',') AS members, CAST(len(ids) AS INTEGER) AS n FROM g""")
def duplicate_groups(spark, d):
    groups = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h")).groupBy("h").agg(F.array_sort(F.collect_set("doc_id")).alias("ids")).where(F.size("ids") > 1)
    return groups.select(F.array_join(F.col("ids").cast("array<string>"), ",").alias("members"), F.size("ids").alias("n"))


@query("duplicate_rows", "WITH d AS (SELECT doc_id, md5(text) AS h FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class, count(*) OVER (PARTITION BY h) AS n FROM d WHERE h IS NOT NULL QUALIFY count(*) OVER (PARTITION BY h) > 1")
def duplicate_rows(spark, d):
    return K.classes(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", F.md5(F.col("text").cast("binary")))


@query("series_gap_ranges", with_("book_series") + "SELECT series_id, a + 1 AS first, n - 1 AS last FROM (SELECT series_id, a, lead(a) OVER (PARTITION BY series_id ORDER BY a) AS n FROM (SELECT DISTINCT series_id, CAST(position AS BIGINT) AS a FROM book_series WHERE position = round(position))) WHERE n > a + 1")
def series_gap_ranges(spark, d):
    return K.gap_ranges(frame(spark, d, "book_series"), "series_id")


@query("majority_language", "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang DESC) AS r FROM documents WHERE trim(lang) <> '' GROUP BY source, lang) WHERE r = 1")
def majority_language(spark, d):
    counts = spark.read.parquet(f"{d}/documents.parquet").where("trim(lang) <> ''").groupBy("source", "lang").count()
    return counts.groupBy("source").agg(F.max_by("lang", F.struct("count", "lang")).alias("lang"))


@query("format_values", "SELECT o_orderkey, CASE WHEN s >= 3600 THEN concat(CAST(s // 3600 AS VARCHAR), 'h ', CAST(s % 3600 // 60 AS VARCHAR), 'm') WHEN s >= 60 THEN concat(CAST(s // 60 AS VARCHAR), 'm ', CAST(s % 60 AS VARCHAR), 's') ELSE concat(CAST(s AS VARCHAR), 's') END AS duration, format('{:t.}', n) AS grouped FROM (SELECT o_orderkey, o_orderkey * 7 % 9000 AS s, o_orderkey * 12345 AS n FROM orders)".replace("{:t.}", "{:t.d}"))
def format_values(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", N.duration_text(F.col("o_orderkey") * 7 % 9000).alias("duration"), N.grouped_integer(F.col("o_orderkey") * 12345, ".").alias("grouped"))
