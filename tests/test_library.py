"""Stated cases of the library's operators."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalar as N
from lectern.operators import catalog as C
from lectern.operators import consensus as K
from lectern.operators import facets
from lectern.operators import search as X
from lectern.operators import state as S
from lectern.operators import timeline as T
from lectern.sources import formats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_decades(spark):
    rows = spark.createDataFrame([("2012-03-04",), ("2019-11-30",), ("1995",), (None,)], "release_date string")
    got = {r.label: r["count"] for r in facets.breakdown(rows, facets.decade(F.col("release_date")), None, True).collect()}
    assert got == {"2010s": 2, "1990s": 1, "unknown": 1}


def test_lengths(spark):
    rows = spark.createDataFrame([(2,), (6,), (30,)], "h long").select((F.col("h") * 3_600_000).alias("ms"))
    assert sorted(r[0] for r in rows.select(facets.length_bucket(F.col("ms"))).collect()) == ["25h+", "4-8h", "<4h"]


def test_empty_stats(spark):
    rows = spark.createDataFrame([], "deleted_at timestamp, reading_status string, duration_ms long")
    assert tuple(facets.stats(rows).first()) == (0, 0, 0, 0, 0, 0.0, 0.0)


def test_wildcards_in_a_filter(spark):
    rows = spark.createDataFrame([("The Way of Kings", None), ("Mistborn", None), ("a\\b", None)], "title string, deleted_at string")
    assert rows.where(C.predicates(C.CatalogueFilter(q="kIngs"))).count() == 1
    assert rows.where(C.predicates(C.CatalogueFilter(q="m_st"))).count() == 1
    assert rows.where(C.predicates(C.CatalogueFilter(q="a\\b"))).count() == 1


def test_series_gaps(spark):
    rows = [(1, 1.0), (1, 3.0), (1, 5.0), (2, 1.0), (2, 1.5), (2, 2.0), (2, 4.0), (3, 1.0)]
    got = {r.s: (r.missing, r.fractional) for r in K.series_gaps(spark.createDataFrame(rows, "s int, position double"), "s").collect()}
    assert got == {1: ([2, 4], []), 2: ([3], [1.5]), 3: ([], [])}


def test_franchise(spark):
    rows = [(1, "Star Wars: A New Hope"), (1, "Star Wars: The Empire Strikes Back"), (1, "Star Wars: Sarek"), (2, "A: One"), (2, "A: Two"), (3, "The Final Empire"), (3, "The Way of Kings"), (4, "alone")]
    got = {r.s: r.prefix for r in K.franchise_prefix(spark.createDataFrame(rows, "s int, title string"), "s").collect()}
    assert got == {1: "Star Wars: ", 2: None, 3: None}


def test_cut(spark):
    rows = spark.createDataFrame([(0, 20_000), (20_000, 40_000), (40_000, 60_000)], "start_ms long, end_ms long")
    got = [tuple(r) for r in T.shift_for_cut(rows, F.lit(10_000), F.lit(15_000), F.lit(0)).collect()]
    assert got == [(0, 15_000), (15_000, 35_000), (35_000, 55_000)]


def test_hamming_and_slide(spark):
    a = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    assert one(spark, T.hamming(a(1, 2), a(1))) == 32
    assert one(spark, T.hamming(a(0), a(7))) == 3
    assert tuple(one(spark, T.slide_match(a(5, 6), a(1, 5, 6, 5, 6)))) == (0, 1)
    assert one(spark, T.slide_match(a(5, 6), a(1))) is None


def test_folding_and_correction(spark):
    assert one(spark, X.tokens(F.lit("Café SOCIETY, Straße"))) == ["cafe", "society", "straße"]
    with pytest.raises(ValueError):
        X.quoted('  " ')
    rows = spark.createDataFrame([(1, "Then Caladin rose."), (2, "Adolin watched."), (3, "a caladin"), (4, None)], "k int, text string")
    got = {r.k: r.text for r in X.corrected(rows, "k", "text", ["Kaladin", "Two Words"]).collect()}
    assert got == {1: "Then Kaladin rose.", 2: "Adolin watched.", 3: "a caladin", 4: None}


def test_scalars(spark):
    assert one(spark, N.duration_text(F.lit(3725))) == "1h 2m"
    assert one(spark, N.duration_text(F.lit(65))) == "1m 5s"
    assert one(spark, N.strip_html(F.lit("<html><body>a<!-- x --> <b>b</b>&amp;c</body></html>"))) == "a b &c"
    assert one(spark, N.strip_subtitle(F.lit("Title: The Sub"), F.lit("the sub"))) == "Title"
    assert one(spark, N.long_date(F.lit("2020-03-04").cast("date"), "de")) == "4. März 2020"
    assert one(spark, N.filename_slug(F.lit("///"))) == "book"


def test_state(spark):
    assert [one(spark, S.backoff(F.lit(n), F.lit(600))) for n in (0, 2, 3, 4, 99)] == [600, 600, 1200, 2400, 86_400]
    got = one(spark, S.json_diff(F.lit('{"a": 1, "b": 2}'), F.lit('{"b": 3, "c": null}')))
    assert [tuple(r) for r in got] == [("a", "removed", "1", None), ("b", "changed", "2", "3")]


def test_formats(spark):
    assert one(spark, formats.cue_ms(F.lit("01:02:74"))) == 62_987
    assert one(spark, formats.cue_ms(F.lit("01:60:00"))) is None
    sheet = 'TRACK 01 AUDIO\n TITLE "One"\n INDEX 01 00:00:00\nTRACK 02 AUDIO\n TITLE "Two"\n INDEX 01 00:10:00\n'
    assert [tuple(r) for r in one(spark, formats.cue_sheet(F.lit(sheet)))] == [("One", 0), ("Two", 10_000)]
    companions = spark.createDataFrame([("/a/b/x.pdf",), ("/a/y.pdf",), ("/c/z.pdf",)], "path string")
    books = spark.createDataFrame([("/a/b", 1), ("/a", 2)], "dir string, book_id int")
    assert {r.path: r.state for r in formats.paired(companions, books).collect()} == {"/a/b/x.pdf": "ambiguous", "/a/y.pdf": "paired", "/c/z.pdf": "unpaired"}


def test_moved_files(spark):
    known = spark.createDataFrame([("/a", "k1"), ("/b", "k2")], "path string, content_key string")
    seen = spark.createDataFrame([("/a", "k9"), ("/c", "k2"), ("/d", "k3")], "path string, content_key string")
    assert {r.path: (r.state, r.old_path) for r in formats.moved(known, seen).collect()} == {"/a": ("PathKnown", None), "/c": ("Moved", "/b"), "/d": ("Inserted", None)}


def test_audio_walk(spark, tmp_path):
    for name in ("x/1.mp3", "x/2.MP3", "y/only.m4b", "y/note.txt", "skip/3.mp3"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"0")
    files = formats.audio_files(spark, str(tmp_path), ["skip"])
    assert sorted((r.title, len(r.files)) for r in formats.books_of(files).collect()) == [("only", 1), ("x", 2)]
