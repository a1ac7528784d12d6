"""Stated cases of codes, releases, chapters, signatures, identity and state."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import codes as N
from lectern.operators import consensus, facets, identity, search, state
from lectern.operators import timeline as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_language_codes(spark):
    cases = {"en": "en", "eng": "en", "en-US": "en", "English": "en", "zh-Hans": "zh-Hans", "ZH-hant": "zh-Hant", "klingon": None, "  ": None, "Deutsch": "de", "ger": "de", "français": "fr"}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", N.language_code(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == cases | {None: None}
    assert [one(spark, N.language_name(F.lit(c), x)) for c, x in (("de", "en"), ("de", "de"), ("en", "de"), ("zh-Hans", "en"), ("klingon", "en"), ("de", "sv"))] == ["German", "Deutsch", "Englisch", "Mandarin (Simplified)", "Unknown", "German"]


def test_genre_codes(spark):
    cases = {"Science Fiction": "science-fiction", "SF": "science-fiction", "\tNon-Fiction\n": "non-fiction", "Children's Non-Fiction": "children-non-fiction", "Self—Help": "self-help", "xxxx": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", N.genre_code(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == cases


def test_release_states(spark):
    cases = {"2025-04-15T00:00:00Z": "released", "2025-04-15T00:00:00-07:00": "released", "2026-01-01": "scheduled", N.NO_DATE: "announced", " ": "unknown", "soon": "unknown", "2025-13-40": "unknown", None: "unknown"}
    now = F.to_timestamp(F.lit("2025-06-01T00:00:00Z"))
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", N.release_state(F.col("t"), now).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases


def test_bookends(spark):
    rows = spark.createDataFrame([([1, 2], [7, 8], [1, 2, 0, 0, 0, 0, 7, 8])], "head array<int>, tail array<int>, hashes array<int>")
    assert T.bookend(rows, 3).first().ends is None
    assert tuple(T.bookend(rows, 4).first().ends) == (0, 0, 0, 6)
    assert T.bookend(rows.withColumn("tail", F.array(*[F.lit(1)] * 9))).first().ends is None


def test_descendants_of_a_long_chain(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(i, i + 1) for i in range(80)] + [(5, 3)], "parent long, child long")
    assert consensus.descendants(edges, F.col("ancestor") == 0).count() == 80


def test_facets_past_the_long_tail(spark):
    rows = spark.createDataFrame([(f"l{i:02}",) for i in range(30) for _ in range(30 - i)], "l string")
    out = facets.breakdown(rows, F.col("l")).collect()
    assert len(out) == 21 and {r.label: r["count"] for r in out}["Others"] == sum(range(1, 11)) and abs(sum(r.percentage for r in out) - 100) < 0.01
    assert facets.breakdown(rows.limit(0), F.col("l")).count() == 0


@pytest.mark.parametrize("title,empty", [(None, True), ("", True), ("03", True), ("Chapter 7:", True), ("Pt. 2", True), ("Chapter Seven", False), ("1984 revisited", False)])
def test_placeholders(spark, title, empty):
    assert one(spark, T.placeholder(F.lit(title).cast("string"))) is empty


def test_sync_guards_against_clocks_ahead(spark):
    now = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    progress = spark.sql("SELECT * FROM VALUES (1, 10L, false, TIMESTAMP_NTZ '2025-02-01 00:00:00'), (2, 10L, false, TIMESTAMP_NTZ '2024-02-01 00:00:00') AS t(book_id, position_ms, is_finished, synced_at)")
    requests = spark.sql("SELECT * FROM VALUES (1, 1, 99L, true), (2, 1, 50L, false), (2, 2, 60L, true), (3, 1, 5L, false) AS t(book_id, request_id, position_ms, is_finished)")
    assert {r.book_id: (r.position_ms, r.is_finished) for r in state.synced(progress, requests, now).collect()} == {1: (10, False), 2: (60, True), 3: (5, False)}


def test_nested_differences(spark):
    pre, post = '{"a":{"b":1,"c":{"d":[1]}},"e":null,"g":"x"}', '{"a":{"b":2,"c":{"d":[1]}},"e":5,"f":{"h":1}}'
    out = state.nested_diff(spark.createDataFrame([(1, pre, post)], "id long, x string, y string"), "id", "x", "y").collect()
    assert {(r.path, r.kind, r.before, r.after) for r in out} == {("a.b", "changed", "1", "2"), ("e", "added", None, "5"), ("f", "added", None, '{"h":1}'), ("g", "removed", '"x"', None)}


def test_fuzzy_only_where_nothing_is_exact(spark):
    docs = spark.createDataFrame([(1, "The Way of Kings"), (2, "Kingsway"), (3, None)], "id long, title string")
    page = lambda words, phrase: [(r.id, r.fuzzy) for r in search.search(docs, "id", ["title"], "title", words, phrase).collect()]
    assert page(["kings"], "kings") == [(1, False)] and page(["ingsw"], "ingsw") == [(2, True)] and page(["xyz"], "xyz") == []


def test_warnings_and_aliases(spark):
    raw = spark.createDataFrame([(1, 1, "Self Harm", "MILD"), (1, 2, "self_harm", "graphic"), (1, 3, "boredom", "mild"), (1, 4, "war", "loud")], "id long, place int, label string, severity string")
    assert [tuple(r) for r in identity.warnings(raw, "id").collect()] == [(1, "self_harm", "mild")]
    aliases = spark.createDataFrame([(1, "Ann", True), (1, "Anna", False), (2, "Bo", True)], "k long, alias string, is_prime boolean")
    chosen = spark.createDataFrame([(1, "ANNA"), (3, "Cy")], "k long, alias string")
    assert {tuple(r) for r in identity.exalted(aliases, chosen, "k").collect()} == {(1, "Ann", False), (1, "Anna", True), (2, "Bo", True), (3, "Cy", True)}
