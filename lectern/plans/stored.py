"""Queries over stored state: the search index, saved queries, names, hierarchies, the journal, cleanups, tasks and seeds."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import cleanup, hierarchy, journal, names, search_index, tasks
from lectern.operators import saved_queries as Q
from lectern.operators.search import quoted
from lectern.plans.catalog import _CAT, _rows
from lectern.plans.standins import frame, with_
from lectern.sources import seeds
from lectern.sources.versions import Versioned, shared_folder

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


def _index(spark: SparkSession, d: str, table: str, key: str, columns: list[str], title: str) -> Versioned:
    """The index of a table: built once for each state of its files, then read. Every 17th document counts as deleted."""
    docs = _read(spark, d, table)
    jvm = spark.sparkContext._jvm
    state = []
    for file in sorted(docs.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        at = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        state.append((file, at.getLen(), at.getModificationTime()))
    index = Versioned(spark, f"{shared_folder(spark)}/search-{table}-{hashlib.sha256(repr((state, columns)).encode()).hexdigest()[:24]}")
    if not index.number():
        search_index.build(index, docs, key, columns, title, F.col(key) % 17 == 0)
    return index


def _documents(spark, d):
    return _index(spark, d, "documents", "doc_id", ["text"], "source")


def _pages(spark, d):
    return _index(spark, d, "pages", "page_id", ["url", "html"], "url")


def _bm25(words: list[str], prefix: bool = False, table: str = "documents", key: str = "doc_id", text: str = "text", title: str = "source") -> str:
    """Rows (key, title, score) of a table that hold all words, as DuckDB reads the texts."""
    hit = lambda w: f"starts_with(x, {w!r})" if prefix else f"x = {w!r}"
    tf = ", ".join(f"len(list_filter(t, lambda x: {hit(w)})) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count_if(tf{i} > 0) AS df{i}" for i in range(len(words)))
    idf = lambda i: f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END"
    part = " + ".join(f"{idf(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(words)))
    every = " AND ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"""WITH t AS (SELECT {key}, {title} AS title, list_filter(string_split_regex(lower(strip_accents({text})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS t FROM {table}),
c AS (SELECT {key}, lower(title) AS title, len(t) AS length, {tf} FROM t), f AS (SELECT count(*) AS n, avg(length) AS mean, {df} FROM c), s AS (SELECT {key}, title, {part} AS score FROM c, f WHERE {every}) """


def _search(name: str, words: list[str], prefix: bool = False):
    @query(name, _bm25(words, prefix) + "SELECT doc_id, round(score, 6) AS score FROM s")
    def run(spark, d):
        return search_index.match(_documents(spark, d), words, prefix).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_search("search_exact", quoted('"licensed" under'))
_search("search_common", ["the", "and"])
_search("search_prefix", ["lic", "th"], True)


@query("search_top", _bm25(["the", "of"]) + "SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT 50")
def search_top(spark, d):
    rows = search_index.match(_documents(spark, d), ["the", "of"]).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
    return rows.orderBy(F.desc("score"), "doc_id").limit(50)


@query("search_live", _bm25(["the", "of"]) + "SELECT doc_id, round(score, 6) AS score, false AS fuzzy, CAST(count(*) OVER () AS BIGINT) AS total FROM s WHERE doc_id % 17 <> 0 ORDER BY round(s.score, 9) DESC, title, doc_id LIMIT 50 OFFSET 10")
def search_live(spark, d):
    out = search_index.page(_documents(spark, d), ["the", "of"], live=True, offset=10)
    return out.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "fuzzy", "total")


_PAGES = {"table": "pages", "key": "page_id", "text": "concat_ws(' ', url, html)", "title": "url"}


@query("search_page", _bm25(["html", "the"], **_PAGES) + "SELECT page_id, round(score * 1e6, 6) AS score, false AS fuzzy, CAST(count(*) OVER () AS BIGINT) AS total FROM s ORDER BY round(s.score, 9) DESC, title, page_id LIMIT 500")
def search_page(spark, d):
    out = search_index.page(_pages(spark, d), ["html", "the"], limit=9999)
    return out.select(F.col("key").alias("page_id"), F.round(F.col("score") * 1e6, 6).alias("score"), "fuzzy", "total")


@query("search_gated", "SELECT page_id, 0.0::DOUBLE AS score, true AS fuzzy, CAST(0 AS BIGINT) AS total FROM pages WHERE contains(lower(coalesce(url, '')), 'xampl') OR contains(lower(coalesce(html, '')), 'xampl') ORDER BY lower(url), page_id LIMIT 50")
def search_gated(spark, d):
    out = search_index.page(_pages(spark, d), ["xampl"], docs=_read(spark, d, "pages"), key="page_id", columns=("url", "html"), phrase="XAMPL")
    return out.select(F.col("key").alias("page_id"), "score", "fuzzy", "total")


@query("search_total", _bm25(["lic", "th"], True) + "SELECT count(*) AS total FROM s WHERE doc_id % 17 <> 0")
def search_total(spark, d):
    return search_index.total(_documents(spark, d), ["lic", "th"], prefix=True, live=True)


#: Stored filters, one of each nation, of many shapes; two are broken.
_FILTER = """concat('{"include_deleted":', CASE WHEN n_nationkey % 5 = 0 THEN 'true' ELSE 'false' END,
  CASE WHEN n_nationkey % 2 = 0 THEN concat(',"q":"', CASE n_nationkey % 6 WHEN 0 THEN 'ED' WHEN 2 THEN 'l_b' ELSE '' END, '"') ELSE '' END,
  CASE WHEN n_nationkey % 3 = 1 THEN ',"language":["en","fr"]' WHEN n_nationkey % 3 = 2 THEN ',"language":[]' ELSE '' END,
  CASE WHEN n_nationkey % 4 = 1 THEN concat(',"min_duration_secs":', CAST(n_nationkey * 1000 AS VARCHAR(9)), ',"max_duration_secs":90000') ELSE '' END,
  CASE WHEN n_nationkey % 7 = 3 THEN ',"abridged":true' ELSE '' END, CASE WHEN n_nationkey % 7 = 5 THEN ',"author":"supplier#00"' ELSE '' END,
  CASE WHEN n_nationkey % 6 = 5 THEN ',"imported_after_unix":1430000000,"imported_before_unix":1500000000' ELSE '' END,
  CASE WHEN n_nationkey % 4 = 3 THEN ',"sort":{"dim":"imported_at","dir":"desc"}' ELSE '' END,
  CASE WHEN n_nationkey % 8 = 6 THEN ',"limit":7,"offset":3' WHEN n_nationkey % 8 = 1 THEN ',"limit":9999' ELSE '' END,
  CASE WHEN n_nationkey = 11 THEN ',"colour":"red"' ELSE '' END, CASE WHEN n_nationkey = 12 THEN ',' ELSE '}' END)"""
_SORT = """CASE n_nationkey % 5 WHEN 1 THEN '{"dim":"title","dir":"desc"}' WHEN 3 THEN '{"dim":"title","dir":"asc"}' END"""
_STORED = _CAT + f""", n AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, {_FILTER} AS f, {_SORT} AS s FROM nation),
v AS (SELECT *, query_id NOT IN (11, 12) AS valid, coalesce(json_extract_string(TRY_CAST(s AS JSON), '$.dim'), json_extract_string(TRY_CAST(f AS JSON), '$.sort.dim'), 'book_id') AS dim,
  coalesce(json_extract_string(TRY_CAST(s AS JSON), '$.dir'), json_extract_string(TRY_CAST(f AS JSON), '$.sort.dir'), 'asc') AS dir FROM n),
w AS (SELECT query_id, dim, dir, TRY_CAST(f AS JSON) AS j FROM v WHERE valid),
m AS (SELECT query_id, dim, dir, j, cat.* FROM w, cat WHERE (json_extract_string(j, '$.include_deleted') = 'true' OR deleted_at IS NULL)
  AND title ILIKE concat('%', coalesce(json_extract_string(j, '$.q'), ''), '%') AND (json_extract_string(j, '$.author') IS NULL OR author ILIKE concat('%', json_extract_string(j, '$.author'), '%'))
  AND (coalesce(json_array_length(j, '$.language'), 0) = 0 OR language IN ('en', 'fr'))
  AND (json_extract_string(j, '$.min_duration_secs') IS NULL OR duration_ms BETWEEN CAST(json_extract_string(j, '$.min_duration_secs') AS BIGINT) * 1000 AND 90000000)
  AND (json_extract_string(j, '$.abridged') IS NULL OR abridged) AND (json_extract_string(j, '$.imported_after_unix') IS NULL OR epoch(created_at) BETWEEN 1430000000 AND 1500000000)) """


def _saved(spark, d) -> DataFrame:
    stored = _read(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS query_id", f"{_FILTER.replace('VARCHAR(9)', 'STRING')} AS query_json", f"{_SORT} AS sort_json")
    return Q.parsed(stored)


@query("saved_query_counts", _STORED + "SELECT v.query_id, valid, CASE WHEN valid THEN (SELECT count(*) FROM m WHERE m.query_id = v.query_id) END AS total FROM v")
def saved_query_counts(spark, d):
    return Q.counted(_rows(spark, d), _saved(spark, d))


@query("saved_query_pages", _STORED + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
  CASE WHEN dim = 'title' AND dir = 'asc' THEN title END, CASE WHEN dim = 'title' AND dir = 'desc' THEN title END DESC,
  CASE WHEN dim = 'imported_at' AND dir = 'asc' THEN created_at END, CASE WHEN dim = 'imported_at' AND dir = 'desc' THEN created_at END DESC,
  CASE WHEN dim = 'book_id' AND dir = 'desc' THEN book_id END DESC, book_id) - coalesce(CAST(json_extract_string(j, '$.offset') AS INTEGER), 0) AS place FROM m)
SELECT query_id, CAST(place AS INTEGER) AS place, book_id, title, author, series FROM r WHERE place > 0 AND place <= least(500, coalesce(CAST(json_extract_string(j, '$.limit') AS INTEGER), 100))""")
def saved_query_pages(spark, d):
    return Q.executed(_rows(spark, d), _saved(spark, d)).select("query_id", "place", "book_id", "title", "author", "series")


#: Texts that hold names, from the parts' own words; and what was said of them, with slips.
_CAP = "concat(upper(substr({0}, 1, 1)), lower(substr({0}, 2)))"
_ADJ, _NOUN = (_CAP.format(f"split_part(p_name, ' ', {i})") for i in (1, 2))
_BODY = f"concat('the ', {_NOUN}, ' was ', {_ADJ}, ', or the ', {_CAP.format('p_type')}, ' ', {_NOUN}, ' of Old ', {_ADJ}, chr(10), {_NOUN}, ' fell. Then ', {_CAP.format('p_type')}, chr(39), 's too')"
_BODIES = f"SELECT p_partkey, {_BODY} AS text FROM part"
_SLIP = f"concat('so ', replace({_NOUN}, CASE p_size % 3 WHEN 0 THEN 'o' WHEN 1 THEN 'i' ELSE 'e' END, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'oo' END), ' (', replace({_CAP.format('p_type')}, 'M', 'N'), ') met ', lower(p_name), CASE WHEN p_size % 5 = 0 THEN ' Of OLD' ELSE '' END)"
_SAID = f"SELECT CAST(p_partkey // 6 AS BIGINT) AS book_id, CAST(p_partkey % 6 AS BIGINT) AS idx, CASE WHEN p_size <> 9 THEN {_SLIP} END AS text FROM part"
#: Capitalised runs and their counts, as DuckDB reads them.
_RUN = "SELECT regexp_extract_all(coalesce(text, ''), '\\p{L}[\\p{L}\\p{N}_''’]*|[.!?\\n]') AS w FROM "
_RUNS = f"""bodies AS ({_BODIES}), w AS ({_RUN} bodies UNION ALL {_RUN} documents),
u AS (SELECT w, list_transform(w, lambda x: upper(x[1]) = x[1] AND lower(x[1]) <> x[1]) AS u FROM w),
s AS (SELECT w, list_filter(range(1, len(w) + 1), lambda i: u[i] AND (i = 1 OR NOT u[i - 1])) AS a, list_filter(range(1, len(w) + 1), lambda i: u[i] AND (i = len(w) OR NOT u[i + 1])) AS b FROM u),
e AS (SELECT w, unnest(a) AS a, unnest(b) AS b FROM s),
names AS (SELECT array_to_string(w[a:b], ' ') AS surface, count(*) AS freq FROM e WHERE b > a OR (a > 1 AND w[a - 1] NOT IN ('.', '!', '?', chr(10))) GROUP BY 1 HAVING count(*) >= 3)"""


def _of_part(spark, d, sql):
    return spark.sql(sql.replace("FROM part", "FROM {part}").replace("p_partkey // 6", "p_partkey div 6"), part=_read(spark, d, "part"))


def _names(spark, d):
    return names.name_dictionary(_of_part(spark, d, _BODIES).select("text").unionByName(_read(spark, d, "documents").select("text")), "text")


@query("name_dictionary", f"WITH {_RUNS} SELECT surface, freq FROM names")
def name_dictionary(spark, d):
    return _names(spark, d)


_TOKENS = "[\\p{L}\\p{N}_''’]+|[^\\p{L}\\p{N}_''’]+"


@query("typo_correction", f"""WITH {_RUNS}, k AS (SELECT surface, freq, length(surface) AS n FROM names WHERE NOT contains(surface, ' ')),
t AS (SELECT book_id, idx, regexp_extract_all(coalesce(text, ''), '{_TOKENS}') AS t FROM ({_SAID})),
x AS (SELECT DISTINCT unnest(t) AS w FROM t), y AS (SELECT w FROM x WHERE regexp_matches(w, '^\\p{{Lu}}') AND w NOT IN (SELECT surface FROM k)),
p AS (SELECT w, arg_min(surface, (levenshtein(w, surface) / greatest(length(w), n), -freq, surface)) AS name FROM y, k WHERE levenshtein(w, surface) <= 0.3 * greatest(length(w), n) + 1e-9 GROUP BY w),
o AS (SELECT book_id, idx, i, t[i] AS w FROM t, unnest(range(1, len(t) + 1)) AS r(i)), f AS (SELECT book_id, idx, string_agg(coalesce(p.name, o.w), '' ORDER BY o.i) AS text FROM o LEFT JOIN p USING (w) GROUP BY 1, 2)
SELECT t.book_id, t.idx, coalesce(f.text, '') AS text FROM t LEFT JOIN f USING (book_id, idx)""")
def typo_correction(spark, d):
    rows = _of_part(spark, d, _SAID).select("book_id", "idx", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.struct("book_id", "idx"))
    return names.corrected(rows, "key", "text", _names(spark, d)).select("book_id", "idx", "text")


_KINDS = "SELECT CASE freq % 4 WHEN 0 THEN 'phrase' WHEN 1 THEN 'publisher' WHEN 2 THEN 'author' ELSE 'narrator' END AS kind, CAST(freq % 4 AS INTEGER) AS rank, surface AS name FROM {}"


@query("names_said", f"""WITH {_RUNS}, k AS ({_KINDS.format('names')}),
t AS (SELECT book_id, idx, idx * 5000 AS s, (idx + 1) * 5000 AS e, lower(coalesce(text, '')) AS low, max((idx + 1) * 5000) OVER (PARTITION BY book_id) AS total FROM ({_SAID})),
q AS (SELECT *, 'head' AS place FROM t WHERE s < 10000 UNION ALL SELECT *, 'tail' FROM t WHERE e > total - 5000),
o AS (SELECT *, coalesce(sum(length(low) + 1) OVER (PARTITION BY book_id, place ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM q),
j AS (SELECT book_id, place, string_agg(low, ' ' ORDER BY idx) AS whole FROM q GROUP BY 1, 2),
h AS (SELECT book_id, place, kind, rank, name, instr(whole, lower(name)) - 1 AS a0 FROM j, k WHERE instr(whole, lower(name)) > 0),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY book_id, place ORDER BY rank, a0, name) = 1)
SELECT b.book_id, b.place, kind, name, max(s) FILTER (o.f <= a0) AS start_ms, CASE WHEN max(e) FILTER (o.f <= a0 + length(name)) <= max(s) FILTER (o.f <= a0) THEN max(s) FILTER (o.f <= a0) + 1000 ELSE max(e) FILTER (o.f <= a0 + length(name)) END AS end_ms
FROM b JOIN o ON o.book_id = b.book_id AND o.place = b.place GROUP BY 1, 2, 3, 4, a0""")
def names_said(spark, d):
    s = _of_part(spark, d, _SAID).select("book_id", "idx", (F.col("idx") * 5000).alias("start_ms"), ((F.col("idx") + 1) * 5000).alias("end_ms"), "text")
    known = spark.sql(_KINDS.format("{n}"), n=_names(spark, d))
    return names.stated_names(s, known, 10_000, 5_000)


_EDGES = """SELECT p_partkey * 2 AS place, split_part(p_name, ' ', 1) AS parent, split_part(p_name, ' ', 2) AS child FROM part
UNION ALL SELECT p_partkey * 2 + 1, split_part(p_name, ' ', 2), CASE WHEN p_size % 3 = 0 THEN lower(p_type) ELSE split_part(p_name, ' ', 1) END FROM part"""
_OLD_EDGES = "SELECT lower(p_type) AS parent, split_part(p_name, ' ', 1) AS child FROM part WHERE p_size = 7"


@query("hierarchy_edges", f"""WITH RECURSIVE old AS (SELECT DISTINCT * FROM ({_OLD_EDGES})), f AS (SELECT parent, child, min(place) AS place FROM ({_EDGES}) GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (ORDER BY place, parent, child) AS nth FROM f WHERE parent <> child AND (parent, child) NOT IN (SELECT (parent, child) FROM old)),
up AS (SELECT parent AS a, child AS b FROM old UNION SELECT up.a, old.child FROM up JOIN old ON old.parent = up.b),
r AS (
  SELECT CAST(0 AS BIGINT) AS nth, coalesce((SELECT list(concat(a, '>', b)) FROM up), CAST([] AS VARCHAR[])) AS ways, true AS taken
  UNION ALL
  SELECT n.nth, CASE WHEN list_contains(ways, concat(child, '>', parent)) THEN ways ELSE list_distinct(list_concat(ways, flatten(list_transform(
    list_concat([parent], list_transform(list_filter(ways, lambda x: split_part(x, '>', 2) = parent), lambda x: split_part(x, '>', 1))), lambda p:
    list_transform(list_concat([child], list_transform(list_filter(ways, lambda x: split_part(x, '>', 1) = child), lambda x: split_part(x, '>', 2))), lambda c: concat(p, '>', c)))))) END, NOT list_contains(ways, concat(child, '>', parent))
  FROM r JOIN n ON n.nth = r.nth + 1)
SELECT place, parent, child, taken FROM r JOIN n USING (nth)""")
def hierarchy_edges(spark, d):
    part = _read(spark, d, "part")
    old = spark.sql(_OLD_EDGES.replace("FROM part", "FROM {part}"), part=part)
    return hierarchy.accepted(old, spark.sql(_EDGES.replace("FROM part", "FROM {part}"), part=part))


#: Operations on orders: each sets the status of one; batches of a customer. Every 7th customer's batch begins at a value that isn't there.
_STATE = "SELECT 'order' AS target_kind, CAST(o_orderkey AS BIGINT) AS target_id, 'status' AS field, CASE WHEN o_orderkey % 5 = 1 THEN 'one' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 11 <> 0"
_OPS = """SELECT o_orderkey * 2 + i AS op_id, CASE WHEN o_custkey % 13 <> 0 THEN concat('c', CAST(o_custkey AS VARCHAR(9))) END AS batch_id, 'order' AS target_kind, CAST(o_orderkey AS BIGINT) AS target_id, 'status' AS field,
CASE WHEN i = 0 THEN CASE WHEN o_custkey % 7 = 0 AND o_orderkey % 3 = 0 THEN 'other' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END ELSE 'one' END AS before, CASE WHEN i = 0 THEN 'one' ELSE 'two' END AS after,
CASE WHEN o_orderkey % 4 = 0 THEN 'done' ELSE 'pending' END AS progress FROM orders, (SELECT 0 AS i UNION ALL SELECT 1 AS i) AS x"""
_REPLAY = f"""WITH s AS ({_STATE}), o AS (SELECT *, CASE WHEN batch_id IS NULL THEN concat('o', CAST(op_id AS VARCHAR)) ELSE concat('b', batch_id) END AS batch FROM ({_OPS})),
p AS (SELECT o.*, op_id % 2 AS i, s.value FROM o LEFT JOIN s USING (target_kind, target_id, field) WHERE progress = 'pending'),
bad AS (SELECT target_id FROM p WHERE i = 0 AND before IS DISTINCT FROM value AND value IS DISTINCT FROM 'one'),
f1 AS (SELECT DISTINCT batch FROM p WHERE i = 0 AND target_id IN (SELECT target_id FROM bad)),
l AS (SELECT * FROM p WHERE batch NOT IN (SELECT batch FROM f1)), h AS (SELECT target_id FROM l GROUP BY 1 HAVING min(i) = 1),
f2 AS (SELECT DISTINCT batch FROM l WHERE target_id IN (SELECT target_id FROM h) AND value IS DISTINCT FROM 'one' AND value IS DISTINCT FROM 'two'),
x AS (SELECT batch FROM f1 UNION SELECT batch FROM f2)"""


def _replayed(spark, d):
    orders = _read(spark, d, "orders")
    state = spark.sql(_STATE.replace("FROM orders", "FROM {orders}"), orders=orders)
    ops = spark.sql(_OPS.replace("FROM orders", "FROM {orders}").replace("VARCHAR(9)", "STRING"), orders=orders)
    return journal.replayed(state, ops)


@query("journal_replay", _REPLAY + " SELECT op_id, CASE WHEN progress <> 'pending' THEN progress WHEN batch IN (SELECT batch FROM x) THEN 'failed' ELSE 'done' END AS progress FROM o")
def journal_replay(spark, d):
    return _replayed(spark, d)[1].select("op_id", "progress")


@query("journal_state", _REPLAY + """, g AS (SELECT target_id, arg_max(after, op_id) AS last FROM p WHERE batch NOT IN (SELECT batch FROM x) GROUP BY 1),
b AS (SELECT target_id, arg_min_null(before, op_id) AS first, bool_or(after = value) AS hit FROM p WHERE batch IN (SELECT batch FROM x) GROUP BY 1),
a AS (SELECT target_id FROM s UNION SELECT target_id FROM g)
SELECT a.target_id, CASE WHEN g.last IS NOT NULL THEN g.last WHEN b.hit THEN b.first ELSE s.value END AS value FROM a LEFT JOIN s USING (target_id) LEFT JOIN g USING (target_id) LEFT JOIN b USING (target_id)
WHERE CASE WHEN g.last IS NOT NULL THEN g.last WHEN b.hit THEN b.first ELSE s.value END IS NOT NULL""")
def journal_state(spark, d):
    return _replayed(spark, d)[0].select("target_id", "value")


_EDITS = "SELECT concat('b', CAST(user_id AS VARCHAR(9))) AS batch_id, 'book_files' AS target_kind, CAST(event_id % 50 AS BIGINT) AS target_id, event_type AS field, lag(CAST(value AS VARCHAR(9))) OVER (PARTITION BY user_id, event_type, event_id % 50 ORDER BY event_id) AS before, CAST(value AS VARCHAR(9)) AS after, 'system' AS actor, event_id AS edit_id FROM events"


@query("edit_history", f"""WITH e AS ({_EDITS}), h AS (SELECT * FROM e WHERE target_id % 3 = 0 AND batch_id < 'b3'),
n AS (SELECT batch_id, target_kind, target_id, field, arg_min_null(before, edit_id) AS b, arg_max(after, edit_id) AS a FROM e WHERE batch_id NOT IN (SELECT batch_id FROM h) GROUP BY ALL)
SELECT batch_id, target_id, field, before AS before_value, after AS after_value, 1 AS old FROM h UNION ALL
SELECT batch_id, target_id, field, concat('"', b, '"') , concat('"', a, '"'), 0 FROM n WHERE a IS DISTINCT FROM b""".replace("concat('\"', b, '\"') ", "CASE WHEN b IS NOT NULL THEN concat('\"', b, '\"') END"))
def edit_history(spark, d):
    edits = spark.sql(_EDITS.replace("FROM events", "FROM {events}").replace("VARCHAR(9)", "STRING"), events=_read(spark, d, "events"))
    old = edits.where("target_id % 3 = 0 AND batch_id < 'b3'").select("batch_id", "target_kind", "target_id", "field", F.col("before").alias("before_value"), F.col("after").alias("after_value"), "actor")
    out = journal.appended(old, edits)
    quoted = F.col("after_value").startswith('"')
    return out.select("batch_id", "target_id", "field", "before_value", "after_value", F.when(quoted, 0).otherwise(1).alias("old"))


_NOW = "2024-04-01 00:00:00"
_JOURNAL = "SELECT event_id AS op_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'pending' ELSE 'done' END AS progress, ts AS created_at FROM events"
_NEARBY = "SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS discovered_at FROM orders"
_REFS = "SELECT l_partkey * 100000000 + l_orderkey * 10 + l_linenumber AS file_id, CASE WHEN l_quantity > 10 THEN l_shipdate END AS released_at FROM lineitem WHERE l_quantity < 20"
_FILES = "SELECT file_id, book_id, lower(format) AS format, is_active FROM files"


def _cleaned(spark, d) -> dict[str, DataFrame]:
    sql = lambda text, **t: spark.sql(text, **t)
    return {
        "journal": sql(_JOURNAL.replace("FROM events", "FROM {e}"), e=_read(spark, d, "events")),
        "nearby": sql(_NEARBY.replace("FROM orders", "FROM {o}").replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)"), o=_read(spark, d, "orders")),
        "files": sql(_FILES.replace("FROM files", "FROM {f}"), f=frame(spark, d, "files")),
        "refs": sql(_REFS.replace("FROM lineitem", "FROM {l}"), l=_read(spark, d, "lineitem")),
    }


_TAKEN = with_("files") + f""", j AS ({_JOURNAL}), n AS ({_NEARBY}), r AS ({_REFS}), f AS ({_FILES}),
tj AS (SELECT op_id FROM j WHERE progress IN ('done', 'failed', 'reversed') AND created_at < TIMESTAMP '{_NOW}' - INTERVAL 90 DAY),
tn AS (SELECT id FROM n WHERE discovered_at < TIMESTAMP '{_NOW}' - INTERVAL 90 DAY),
tf AS (SELECT file_id FROM f WHERE is_active AND format <> 'm4b' AND book_id IN (SELECT book_id FROM f WHERE is_active AND format = 'm4b') AND file_id NOT IN (SELECT file_id FROM r WHERE released_at IS NULL))"""


@query("cleanup_report", _TAKEN + """ SELECT 'journal' AS name, 'records' AS category, true AS enabled, (SELECT count(*) FROM tj) AS "rows" UNION ALL SELECT 'nearby_books', 'hints', false, 0 UNION ALL SELECT 'transcoded_sources', 'files', true, (SELECT count(*) FROM tf)""")
def cleanup_report(spark, d):
    return cleanup.report(_cleaned(spark, d), cleanup.TARGETS, F.lit(_NOW).cast("timestamp_ntz"), {"records", "files"})


@query("cleanup_kept", _TAKEN + """ SELECT 'journal' AS name, count(*) AS kept FROM j WHERE op_id NOT IN (SELECT op_id FROM tj) UNION ALL SELECT 'nearby', count(*) FROM n WHERE id NOT IN (SELECT id FROM tn) UNION ALL SELECT 'files', count(*) FROM f WHERE file_id NOT IN (SELECT file_id FROM tf)""")
def cleanup_kept(spark, d):
    out = cleanup.kept(_cleaned(spark, d), cleanup.TARGETS, {"journal": "op_id", "nearby": "id", "files": "file_id"}, F.lit(_NOW).cast("timestamp_ntz"))
    count = lambda n: out[n].agg(F.count("*").alias("kept")).select(F.lit(n).alias("name"), "kept")
    return count("journal").unionByName(count("nearby")).unionByName(count("files"))


_MATCHES = """SELECT l_partkey * 100000000 + l_orderkey * 10 + l_linenumber AS row_id, l_orderkey AS book_id, l_partkey * 100000000 + l_orderkey * 10 + l_linenumber AS file_id, 'intro' AS kind,
CASE l_linenumber % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'fingerprint_full' WHEN 2 THEN 'fingerprint_bookend' ELSE 'transcript' END AS method, 1 - l_discount * 2 AS confidence,
CASE l_returnflag WHEN 'A' THEN 'applied' WHEN 'N' THEN 'candidate' ELSE 'rejected' END AS status, CAST(l_suppkey % 7 AS BIGINT) * 1000 AS start_ms, CAST(l_suppkey % 7 + 5 AS BIGINT) * 1000 AS end_ms,
CASE WHEN l_linenumber = 1 THEN CAST(500 AS BIGINT) END AS padding_ms FROM lineitem"""
_CUT = f"""WITH m AS (SELECT *, status = 'candidate' AND ((method = 'fingerprint_full' AND confidence >= 0.85) OR (method = 'fingerprint_bookend' AND confidence >= 0.8)) AS ready FROM ({_MATCHES})), k AS (SELECT *, greatest(0, end_ms - start_ms - coalesce(padding_ms, 0)) AS cut FROM m WHERE ready)"""


def _promoted(spark, d):
    lines, part = _read(spark, d, "lineitem"), _read(spark, d, "orders")
    matches = spark.sql(_MATCHES.replace("FROM lineitem", "FROM {l}"), l=lines)
    chapters = lines.selectExpr("l_partkey * 100000000 + l_orderkey * 10 + l_linenumber AS file_id", "explode(array(0L, 1L, 2L)) AS idx").selectExpr("file_id", "idx", "idx * 9000 AS start_ms", "(idx + 1) * 9000 AS end_ms")
    books = part.selectExpr("o_orderkey AS book_id", "CAST(o_totalprice AS BIGINT) AS duration_ms", "'candidate' AS audiologo_status")
    return cleanup.promoted(matches, chapters, books)


@query("applied_matches", _CUT + " SELECT row_id, CASE WHEN ready THEN 'applied' ELSE status END AS status FROM m")
def applied_matches(spark, d):
    return _promoted(spark, d)[0].select("row_id", "status")


@query("applied_chapters", _CUT + """, c AS (SELECT file_id, i * 9000 AS s, (i + 1) * 9000 AS e, i FROM m, (SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS i))
SELECT file_id, i AS idx, CAST(s - coalesce((SELECT sum(cut) FROM k WHERE k.file_id = c.file_id AND c.s >= k.end_ms), 0) AS BIGINT) AS start_ms, CAST(e - coalesce((SELECT sum(cut) FROM k WHERE k.file_id = c.file_id AND c.e >= k.end_ms), 0) AS BIGINT) AS end_ms FROM c""")
def applied_chapters(spark, d):
    return _promoted(spark, d)[1]


@query("applied_books", _CUT + ", b AS (SELECT book_id, sum(cut) AS lost FROM k GROUP BY 1) SELECT o_orderkey AS book_id, CAST(greatest(0, CAST(floor(o_totalprice) AS BIGINT) - coalesce(lost, 0)) AS BIGINT) AS duration_ms, CASE WHEN lost IS NULL THEN 'candidate' ELSE 'applied' END AS audiologo_status FROM orders LEFT JOIN b ON b.book_id = o_orderkey")
def applied_books(spark, d):
    return _promoted(spark, d)[2]


@query("task_states", """WITH r AS (SELECT user_id AS task, ts AS t, event_id AS run_id, event_type NOT IN ('error', 'view', 'click') AS ok, event_type AS summary FROM events), k AS (SELECT CAST(c_custkey AS BIGINT) AS task, CAST(600 AS BIGINT) AS i FROM customer),
g AS (SELECT task, max((t, run_id)) AS good FROM r WHERE ok GROUP BY 1),
s AS (SELECT k.task, max(t) AS last_run_at, arg_max(ok, (t, run_id)) AS ok, arg_max(summary, (t, run_id)) AS last_summary, count_if(r.run_id IS NOT NULL AND NOT ok AND (good IS NULL OR (t, run_id) > good)) AS failures FROM k LEFT JOIN r USING (task) LEFT JOIN g USING (task) GROUP BY 1)
SELECT task, last_run_at, CASE WHEN ok THEN 'ok' WHEN NOT ok THEN 'error' END AS last_status, last_summary, failures,
  last_run_at + to_seconds(CAST(CASE WHEN failures < 3 THEN 600 ELSE least(600 * pow(2, least(failures - 2, 20)), 86400) END AS BIGINT)) AS next_run_at FROM s""")
def task_states(spark, d):
    runs = _read(spark, d, "events").selectExpr("user_id AS task", "ts AS at", "event_id AS run_id", "event_type NOT IN ('error', 'view', 'click') AS ok", "event_type AS summary")
    return tasks.states(runs, _read(spark, d, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS task", "600L AS interval_s"))


@query("task_islands", """WITH r AS (SELECT user_id AS task, ts AS t, event_id AS run_id, event_type <> 'error' AS ok FROM events), e AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY t, run_id) - row_number() OVER (PARTITION BY task, ok ORDER BY t, run_id) AS g FROM r)
SELECT task, ok, min(t) AS first_at, max(t) AS last_at, count(*) AS runs FROM e GROUP BY task, ok, g""")
def task_islands(spark, d):
    runs = _read(spark, d, "events").selectExpr("user_id AS task", "ts AS at", "event_id AS run_id", "event_type <> 'error' AS ok")
    return tasks.islands(runs).select("task", "ok", "first_at", "last_at", "runs")


_SEED = """concat('{"publisher":', CASE WHEN p_size % 4 = 0 THEN 'null' ELSE concat('"', p_brand, '"') END, ',"intro_fingerprint_b64":"', CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END, '"',
CASE WHEN p_size % 2 = 0 THEN concat(',"outro_fingerprint_b64":"x","outro_fingerprint_duration_ms":', CASE WHEN p_size = 10 THEN '"long"' WHEN p_size = 20 THEN '-5' ELSE CAST(p_size AS VARCHAR(9)) END) ELSE '' END, CASE WHEN p_size = 13 THEN ',"title":' ELSE '}' END)"""


@query("seed_counts", f"""WITH s AS (SELECT p_partkey, p_size, p_brand, {_SEED} AS t, p_size IN (10, 13, 20) AS broken FROM part),
f AS (SELECT CASE WHEN p_size % 4 = 0 THEN '(no publisher)' ELSE p_brand END AS publisher, p_size % 3 <> 0 AS intro, p_size % 2 = 0 AS outro FROM s WHERE NOT broken)
SELECT publisher, count_if(intro) AS intros, count_if(outro) AS outros, 0::BIGINT AS broken FROM f GROUP BY 1 HAVING count_if(intro) + count_if(outro) > 0 UNION ALL SELECT '(broken)', 0, 0, count(*) FROM s WHERE broken""")
def seed_counts(spark, d):
    rows = seeds.findings(_read(spark, d, "part").selectExpr("p_partkey", f"{_SEED.replace('VARCHAR(9)', 'STRING')} AS value"))
    good = seeds.by_publisher(seeds.fingerprints(rows, "p_partkey")).select("publisher", "intros", "outros", F.lit(0).cast("long").alias("broken"))
    zero = F.lit(0).cast("long")
    return good.unionByName(rows.where("broken").agg(F.count("*").alias("broken")).select(F.lit("(broken)").alias("publisher"), zero.alias("intros"), zero.alias("outros"), "broken"))
