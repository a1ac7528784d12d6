"""Postings counted within rows, and prefixes read without a join."""

from collections import Counter

from pyspark.sql import functions as F

from lectern.operators import search as X
from lectern.operators import search_index
from lectern.sources.versions import Versioned


def test_terms_are_counted_in_their_row(spark):
    texts = ["b a b", "", None, "...", "É e, e! x" * 3, "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.term): (r.tf, r.length) for r in X.postings(rows, "doc_id", "text").collect()}
    want = {(0, "a"): (1, 3), (0, "b"): (2, 3), (5, "one"): (1, 1)}
    own = Counter("e e e xe e e xe e e x".split())
    assert got == want | {(4, t): (n, 10) for t, n in own.items()}
    once = rows.select("doc_id", F.inline(X.counted(F.col("text"))))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    twice = X.postings(rows.unionByName(rows.where("doc_id = 0")), "doc_id", "text").where("doc_id = 0")
    assert sorted((r.term, r.tf, r.length) for r in twice.collect()) == [("a", 2, 3), ("b", 4, 3)]


def test_prefixes_need_no_join(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the thin licence", "A"), (2, "then licensed, licit", "B"), (3, "lice", "C"), (4, None, "D")], "doc_id long, text string, source string")
    index = Versioned(spark, f"file://{tmp_path}/index")
    search_index.build(index, docs, "doc_id", ["text"], "source")
    rows = search_index.prefixed(index, ["lic", "th", "lice"])
    assert sorted((r.key, r.term, r.tf, r.length) for r in rows.collect()) == [(1, "lic", 1, 3), (1, "lice", 1, 3), (1, "th", 2, 3), (2, "lic", 2, 3), (2, "lice", 1, 3), (2, "th", 1, 3), (3, "lic", 1, 1), (3, "lice", 1, 1)]
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    assert tuple(index.read("figures").first()) == (4, 7)
    assert search_index.total(index, ["lic", "th"], prefix=True).first()["total"] == 2
