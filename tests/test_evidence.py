"""Evidence where few of many candidates decide, against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import identity as I
from lectern.operators import overlap
from lectern.operators.consensus import corroborated


def test_leading_authors_by_all_pairs(spark):
    rng, seen = random.Random(11), set()
    for n_books, n_authors, n_narrators, each in ((60, 12, 14, 2), (60, 12, 200, 1), (80, 6, 30, 3), (60, 20, 8, 3)):
        books = [(b, rng.randrange(n_authors), rng.choice([None, *range(5)])) for b in range(n_books)]
        narrators = [(b, rng.randrange(n_narrators)) for b in range(n_books) for _ in range(rng.randrange(each + 1))]
        series = [(b, rng.choice([None, *range(25)])) for b in range(n_books) if b % 4]
        entities = [(f"k{a % 3}", a) for a in range(n_authors + 3)]
        asked = [(b, f"k{b % 3}") for b in range(n_books)]
        t = [spark.createDataFrame(r, s) for r, s in (
            (asked, "book_id long, name_key string"), (entities, "name_key string, candidate long"), (books, "book_id long, author_id long, publisher_id long"),
            (narrators, "book_id long, narrator_id long"), (series, "book_id long, series_id long"))]
        want = corroborated(I.author_scores(t[0].join(t[1], "name_key").select("book_id", "candidate"), *t[2:]).withColumnRenamed("candidate", "entity_id"), "book_id")
        want = {(r.book_id, r.entity_id): r.score for r in want.collect()}
        assert {tuple(r) for r in I.leading_authors(*t).collect()} == set(want)
        seen |= {round(s, 1) for s in want.values()}
    assert {0.4, 0.5, 0.6, 0.9, 1.1} <= seen


def test_cascade_makes_no_pairs(spark):
    # 20 000 names shared by 20 000 entities are 4 * 10^8 pairs; there is no evidence but one series.
    known = spark.range(20_000).select(F.col("id").alias("entity_id"), F.lit("Pen").alias("alias"), F.lit(None).cast("string").alias("external_id"))
    names = spark.range(20_000).select(F.col("id").alias("row_id"), F.lit(" PEN ").alias("name"), F.lit(None).cast("string").alias("external_id"))
    books = spark.range(20_000).select(F.col("id").alias("book_id"), F.col("id").alias("author_id"), F.lit(None).cast("long").alias("publisher_id"))
    narrators = spark.createDataFrame([], "book_id long, narrator_id long")
    series = spark.createDataFrame([(7, 1), (9, 1)], "book_id long, series_id long")
    out = I.cascade(names, known, lambda asked, entities: I.leading_authors(asked, entities, books, narrators, series))
    assert {(r.row_id, r.entity_id) for r in out.where("outcome = 'corroborated'").collect()} == {(7, 9), (9, 7)}
    assert out.where("outcome = 'deferred'").count() == 19_998


def test_lists_of_values_by_all_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "LISTED", 3)
    rng = random.Random(5)
    pairs = spark.createDataFrame(sorted({(rng.randrange(40), rng.randrange(9)) for _ in range(300)}), "book_id long, candidate long")
    of_book = spark.createDataFrame([(b, rng.choice([None, *range(90)])) for b in range(40) for _ in range(rng.randrange(9))], "book_id long, v long")
    by = spark.createDataFrame([(b, rng.randrange(9)) for b in range(40)], "book_id long, candidate long").join(of_book, "book_id")
    one, other = ({tuple(r) for r in I._elsewhere(pairs, of_book, by, "v", many).collect()} for many in (False, True))
    assert one == other and 20 < len(one) < 250
    sets = I._elsewhere(pairs, of_book, by, "v", True)
    assert sets.count() == len(one) and "arrays_overlap" in sets._jdf.queryExecution().optimizedPlan().toString()


def test_narrators_dealt_by_rows(spark, monkeypatch):
    # Parts were as many as adaptive execution made of the bytes: one here, and 2.8 million rows each at 60 times sf0.1.
    monkeypatch.setattr(I, "DEALT", 100)
    rng = random.Random(3)
    books = [(b, p) for b in range(300) for p in rng.choices([None, *range(40)], k=rng.choice([1, 1, 1, 2]))] + [(5, 1), (5, 1), (None, 2)]
    narrators = [(b, rng.randrange(60)) for b in range(320) for _ in range(rng.randrange(8))] + [(7, 3)] * 500 + [(8, None), (None, 4), (None, None)]
    pairs = narrators + [(b, 50 + b % 30) for b in range(300)]
    of = {}
    for b, p in books:
        if b is not None and p is not None:
            of.setdefault(b, set()).add(p)
    read = {}
    for b, n in narrators:
        for p in of.get(b, ()):
            read.setdefault((n, p), set()).add(b)
    want = {(b, c): 0.2 if c is not None and any(read.get((c, p), set()) - {b} for p in of.get(b, ())) else 0.0 for b, c in pairs}
    t = [spark.createDataFrame(r, s) for r, s in ((pairs, "book_id long, candidate long"), (books, "book_id long, publisher_id long"), (narrators, "book_id long, narrator_id long"))]
    out = I.narrator_scores(*t)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and {(b, c): s for b, c, s in got} == want and 100 < sum(s > 0 for s in want.values()) < len(want) - 100
    sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= len(pairs) / 100 and max(sizes) < 150
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def _odd_tables(spark):
    rng = random.Random(17)
    books = [(b, rng.choice([None, *range(12)]), rng.choice([None, *range(9)])) for b in range(90) for _ in range(rng.choice([1, 1, 1, 2]))] + [(500, 3, 4), (500, 3, 4), (None, 2, 1), (501, 700, 99)]
    narrators = [(b, rng.randrange(60)) for b in range(95) for _ in range(rng.randrange(7))] + [(7, n) for n in range(60, 400)] + [(8, 61)] * 300 + [(500, 900), (8, None), (None, 4), (None, None)]
    series = [(b, rng.choice([None, *range(40)])) for b in range(95) if b % 4] + [(501, 3), (7, 3)]
    pairs = sorted({(rng.randrange(95), rng.randrange(15)) for _ in range(600)}) + [(7, c) for c in range(300)] + [(500, 3), (500, 5), (501, 700), (7, 700), (None, 3), (4, None), (None, None), (7, 3), (600, 1)]
    names = [(c, f"N{c}") for c in range(10)] + [(4, "other"), (11, None), (700, "far"), (None, "none")]
    t = [spark.createDataFrame(r, s).repartition(3) for r, s in (
        (pairs, "book_id long, candidate long"), (books, "book_id long, author_id long, publisher_id long"), (narrators, "book_id long, narrator_id long"),
        (series, "book_id long, series_id long"), (names, "candidate long, display string"))]
    full = lambda rows: {r for r in rows if None not in r}
    read, serial = full(narrators), full(series)

    def met(b, c, rows, of):
        return any(x == b and any((m, v) in of and m != b for m in {m for m, u in of if u == v}) for x, v in rows) if None not in (b, c) else False

    want = {}
    for b, c in set(pairs):
        mine = {m for m, a, _ in books if a == c and m is not None and c is not None}
        s = 0.4 if met(b, c, read, {r for r in read if r[0] in mine}) else 0.0
        s += 0.2 if met(b, c, full((m, p) for m, _, p in books), full((m, p) for m, a, p in books if a == c and c is not None)) else 0.0
        s += 0.5 if met(b, c, serial, {r for r in serial if r[0] in mine}) else 0.0
        want[b, c] = s
    return t, want, names


def test_authors_without_a_list_for_each_pair(spark, monkeypatch):
    # The list of a book's narrators went to each of its candidates: 11 GB at 60 times sf0.1.
    monkeypatch.setattr(overlap, "HELD", 200)
    monkeypatch.setattr(overlap, "PAIRS", 50)
    t, want, _ = _odd_tables(spark)
    out = I.author_scores(*t[:4])
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and {(b, c): s for b, c, s in got} == want
    assert {0.0, 0.2, 0.4, 0.5, 1.1} <= {round(s, 1) for s in want.values()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "arrays_overlap" not in plan


def test_choices_without_a_shuffle_of_names(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HELD", 200)
    t, want, names = _odd_tables(spark)
    rows = {}
    for (b, c), s in want.items():
        for n, display in names:
            if c is not None and n == c:
                rows.setdefault(b, []).append((-s, c, display is not None, display or "", s))
    want = {b: [(c, d if known else None, s) for _, c, known, d, s in sorted(r)] for b, r in rows.items()}
    out = I.pending_authors(*t)
    got = {r.book_id: [tuple(x) for x in r.candidates] for r in out.collect()}
    assert got == want and out.count() == len(want) and None in want
    scores = {r.book_id: [tuple(x) for x in r.candidates] for r in I.pending(I.author_scores(*t[:4]), t[4]).collect()}
    assert scores == want


def test_place_in_own_slices():
    rng = np.random.default_rng(1)
    slices = [np.unique(rng.integers(-30, 30, n)) for n in (1, 2, 3, 40, 64, 7, 1)]
    size = np.array([len(x) for x in slices])
    start, values = np.cumsum(size) - size, np.concatenate(slices)
    which, wanted = rng.integers(0, len(slices), 4000), rng.integers(-35, 35, 4000)
    got = overlap.found_at(values, start[which], size[which], wanted)
    for w, x, g in zip(which, wanted, got, strict=True):
        assert (g == -1 and x not in slices[w]) or (start[w] <= g < start[w] + size[w] and values[g] == x)
