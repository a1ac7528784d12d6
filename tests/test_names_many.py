"""Names with one beginning in a long text."""

from lectern.operators import names


def test_many_names_of_one_beginning(spark):
    # 3000 names begin alike, the text has that beginning 1600 times: each meeting in whole was a copy of the text.
    text = " ".join(f"annalise{i}" for i in range(1600))
    known = [("author", 2, f"Annalise{i}") for i in range(1500, 4500)] + [("phrase", 0, "annalise0 annalise2"), ("publisher", 1, "")]
    rows = names.stated_names(spark.createDataFrame([(1, 0, 0, 9000, text), (2, 0, 0, 9000, "an ann"), (3, 0, 0, 9000, None)], "book_id long, idx long, start_ms long, end_ms long, text string"),
                              spark.createDataFrame(known, "kind string, rank int, name string"))
    assert sorted(tuple(r)[:4] for r in rows.collect()) == [(1, "head", "author", "Annalise1500"), (1, "tail", "author", "Annalise1500")]
