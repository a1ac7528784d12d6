"""Lists, pending names, learned numbers, roots, restores and checks by stated cases."""

import datetime

from pyspark.sql import functions as F

from lectern.functions import scalar as N
from lectern.operators import consensus, facets, keeping

NOW = datetime.datetime(2024, 6, 1)


def test_a_book_without_anything_is_listed(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "B"), (2, "B")], "book_id long, title string")
    files = spark.createDataFrame([(1, 9, "/z"), (1, 3, "/a"), (1, 3, "/a")], "book_id long, file_id long, file_path string")
    members = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 99)], "book_id long, narrator_id long")
    narrators = spark.createDataFrame([(1, "Zed"), (2, "Ann")], "narrator_id long, name string")
    aliases = spark.createDataFrame([(1, "Bo", True), (2, "Cy", False)], "narrator_id long, alias string, is_prime boolean")
    got = sorted((r.book_id, r.file_path or "", r.narrators or "") for r in keeping.listed_books(rows, files, members, narrators, aliases).collect())
    assert got == [(1, "/a", "Ann, Bo"), (2, "", ""), (2, "", "")]


def test_pending_names_without_candidates_stay(spark):
    rows = spark.createDataFrame([(1, 5, "x", False), (2, 5, "y", True)], "pending_id long, book_id long, observed_alias string, resolved boolean")
    some = spark.createDataFrame([(1, 7, "b", 0.5), (1, 8, "a", 0.5), (1, 9, None, None)], "pending_id long, id long, display string, score double")
    got = sorted((r.kind, r.place or 0, r.id or 0) for r in keeping.pending_all({"author": (rows, some), "narrator": (rows, some.limit(0)), "series": (rows.limit(0), some)}).collect())
    assert got == [("author", 1, 7), ("author", 2, 8), ("author", 3, 9), ("narrator", 0, 0)]


def test_learning_keeps_the_first(spark):
    learned = spark.createDataFrame([("a b", "c", "X", "user", "2024-01-01")], "title_norm string, author_norm string, asin string, source string, learned_at string")
    edits = spark.createDataFrame([(" A  b", "C ", "X", "edit", "2024-02-01"), ("A B", "C", "Y", "edit", "2024-02-03"), ("a b", "c", "Y", "late", "2024-02-04"), (" ", "c", "Z", "edit", "1"), ("t", None, "Z", "edit", "1"), ("t", "c", "", "edit", "1")], "title string, author string, asin string, source string, learned_at string")
    once = keeping.captured(learned, edits)
    assert sorted((r.asin, r.source, r.learned_at) for r in once.collect()) == [("X", "user", "2024-01-01"), ("Y", "edit", "2024-02-03")]
    assert keeping.captured(once, edits).count() == 2
    assert [(r.asin, r.total) for r in keeping.learned_page(once, 1, 1).collect()] == [("X", 2)]
    assert keeping.forgotten(once, once.where("asin = 'X'").select("title_norm", "author_norm", "asin")).count() == 1


def test_roots_come_back_and_are_never_forgotten(spark):
    roots = spark.createDataFrame([("/a", "A", True), ("/b", "B", False)], "path string, label string, is_active boolean")
    asked = spark.createDataFrame([(1, "remove", "/a/", None), (2, "add", "/b", None), (3, "remove", "/none", None), (4, "add", "/c//", "C"), (5, "remove", "/c", None), (6, "add", "/", "all"), (7, "add", "", None), (8, "remove", "/a", None)], "request_id long, op string, path string, label string")
    got = sorted(tuple(r) for r in keeping.roots_after(roots, asked).collect())
    assert got == [("/", "all", True), ("/a", "A", False), ("/b", "B", True), ("/c", "C", False)]
    assert sorted(tuple(r) for r in keeping.roots_after(keeping.roots_after(roots, asked), asked).collect()) == got


def test_only_deleted_books_are_purged(spark):
    books = spark.createDataFrame([(1, NOW), (2, None), (3, NOW)], "book_id long, deleted_at timestamp")
    files = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "book_id long, f string")
    out = keeping.purged(books, {"files": files}, spark.createDataFrame([(1,), (2,), (1,)], "book_id long"))
    assert sorted(r.book_id for r in out["books"].collect()) == sorted(r.book_id for r in out["files"].collect()) == [2, 3]
    back = keeping.restored(books, spark.createDataFrame([(1,), (9,)], "book_id long"))
    assert {r.book_id: r.deleted_at for r in back.collect()} == {1: None, 2: None, 3: NOW}


def test_logo_states(spark):
    books = spark.createDataFrame([(1, "none"), (2, "applied"), (3, "x"), (4, "stripped"), (5, None)], "book_id long, audiologo_status string")
    matches = spark.createDataFrame([(1, "rejected"), (1, "re_detected"), (3, "rejected"), (2, "applied"), (2, "candidate")], "book_id long, status string")
    assert {r.book_id: r.audiologo_status for r in keeping.logo_states(books, matches).collect()} == {1: "detected", 2: "applied", 3: "rejected", 4: "stripped", 5: "unknown"}


def test_corroboration_reaches_over_bucket_edges(spark):
    said = spark.createDataFrame([(1, "intro", t, t + 5, "transcript_only", 0.55) for t in (0, 1999, 3999, 4001, 9000)], "file_id long, kind string, start_ms long, end_ms long, method string, confidence double")
    prints = spark.createDataFrame([(1, "intro", 2000), (1, "outro", 9000), (2, "intro", 9000)], "file_id long, kind string, start_ms long")
    assert {r.start_ms: r.confidence for r in keeping.corroborated(said, prints).collect()} == {0: 0.75, 1999: 0.75, 3999: 0.75, 4001: 0.55, 9000: 0.55}


def test_dates_and_entities(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    at = F.lit(1_768_521_600)  # 2026-01-16 00:00:00
    assert one(N.date_text(at, "de-AT", "medium")) == "16. Jan. 2026" and one(N.date_text(at, "fr", "short")) == "16/01/2026" and one(N.date_text(at, "es")) == "16 de enero de 2026"
    assert one(N.datetime_text(at, "en", "short")) == "01/16/2026 12:00 AM" and one(N.datetime_text(at, "en-GB", "short")) == "01/16/2026 00:00"
    assert one(N.date_text(F.lit(0))) == one(N.date_text(F.lit(None).cast("long"))) == "—"
    assert one(N.decoded(F.lit("&amp;lt; &#x1F600;&#55296; &#; & &none; &nbsp;"))) == "&lt; 😀&#55296; &#; & &none;  "


def test_facets_over_many_groups(spark):
    rows = spark.range(3000).selectExpr("id % 77 AS k")
    got = {r.label: (r["count"], r.percentage) for r in facets.breakdown(rows, F.col("k").cast("string"), F.col("k"), most=5).collect()}
    assert len(got) == 6 and sum(n for n, _ in got.values()) == 3000 and abs(sum(p for _, p in got.values()) - 100) < 0.01
    assert {r.label for r in facets.breakdown(rows.where("k < 4"), F.col("k").cast("string"), F.col("k"), most=5).collect()} == {"0", "1", "2", "3"}


def test_gaps_of_any_length_are_rows(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.5), (1, 4.0), (1, 4.0), (1, 1e9), (2, 7.0), (2, -3.0), (3, None)], "series_id long, position double")
    assert sorted(tuple(r) for r in consensus.gap_ranges(rows, "series_id").collect()) == [(1, 2, 3), (1, 5, 999_999_999)]
    same = consensus.classes(spark.createDataFrame([(4, "a"), (2, "a"), (3, None), (5, None), (6, "b")], "id long, t string"), "id", F.col("t"))
    assert sorted(tuple(r) for r in same.collect()) == [(2, 2, 2), (4, 2, 2)]


def test_collections_are_created_once(spark):
    there = spark.createDataFrame([("Old", None)], "name string, note string")
    asked = spark.createDataFrame([(1, " new ", " "), (2, "NEW", "late"), (3, "old", "x"), (4, " ", "x"), (5, None, "x"), (6, "Other", " kept ")], "request_id long, name string, note string")
    rows, log, refused = keeping.created(there, asked, ("note",))
    assert sorted((r.name, r.note or "") for r in rows.collect()) == [("Old", ""), ("Other", "kept"), ("new", "")]
    assert sorted(tuple(r) for r in log.collect()) == [(1, "name", "new"), (6, "name", "Other"), (6, "note", "kept")]
    assert sorted(r.request_id for r in refused.collect()) == [2, 3, 4, 5]


def test_candidates_are_added_once(spark):
    schema = "book_id long, field string, value string, source string, confidence double"
    old = spark.createDataFrame([(1, "t", None, "tag", 0.5), (1, "t", "a", "tag", 0.5)], schema)
    new = spark.createDataFrame([(1, "t", None, "tag", 0.9), (1, "t", "a", "web", 0.1), (1, "t", "a", "web", 0.2), (2, "t", "a", "tag", None)], schema)
    got = keeping.added_candidates(old, new)
    assert sorted((r.book_id, r.value or "", r.source, r.confidence or 0) for r in got.collect()) == [(1, "", "tag", 0.5), (1, "a", "tag", 0.5), (1, "a", "web", 0.2), (2, "a", "tag", 0)]
    assert keeping.added_candidates(got, new).count() == 4


def test_descriptions_and_installs(spark):
    books = spark.createDataFrame([(1, "text", None), (2, " ", None), (3, "text", "fr"), (4, None, None), (5, "text", None)], "book_id long, description string, description_lang string")
    found = spark.createDataFrame([(1, "de"), (2, "de"), (3, "de"), (4, "de"), (5, None)], "book_id long, lang string")
    once = keeping.described(books, found)
    assert {r.book_id: r.description_lang for r in once.collect()} == {1: "de", 2: None, 3: "fr", 4: None, 5: None}
    asked = spark.createDataFrame([("de-AT", False, 3), ("de-AT", False, 1), ("fr", True, 1), ("pt", False, 2)], "locale string, installed boolean, requested_at long")
    held = spark.createDataFrame([(1, "DE", None), (2, "de-CH", None), (3, "de", NOW), (4, "de", None)], "book_id long, language string, deleted_at timestamp")
    waits = spark.createDataFrame([(1, "blocked"), (1, "blocked"), (2, "blocked"), (3, "blocked"), (4, "done")], "book_id long, status string")
    assert sorted(tuple(r) for r in keeping.pending_installs(asked, held, waits).collect()) == [("de-AT", 1, 2), ("pt", 2, 0)]
