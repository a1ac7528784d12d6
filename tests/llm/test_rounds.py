"""Cases of models that can't be fitted, of links in large groups and of records dealt by their bytes."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import minhash, quality, suffix_dedup, toxicity, warc
from lectern.llm.shared import new_path, written


@pytest.mark.parametrize("copies", [200, 800])
def test_links_stay_near_one_a_document(spark, monkeypatch, copies):
    rng = random.Random(copies)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(copies):
        own = list(base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(own)))
    links = []

    def counted(df, name):
        out = written(df, name)
        if name == "links":
            links.append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", counted)
    minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert 0 < sum(links) <= 2 * copies


def test_spanning_links_of_families(spark):
    a, b = "a b c d e f g h i j k l", "a b c d e f g h i j k x"
    texts = spark.createDataFrame([(i, a if i % 2 else b) for i in range(40)], "doc_id long, text string")
    every = texts.select("doc_id", F.when(F.col("doc_id") < 30, 0).otherwise(F.col("doc_id")).cast("long").alias("label"))
    apart = every.where("label > 0").select(F.lit(0).cast("long").alias("family"), "doc_id")
    got = [(r.a, r.b) for r in minhash.confirm_families(apart, every, texts, 2, 80, block=4, spanning=True).collect()]
    assert {x for x, _ in got} | {y for _, y in got} == {0, *range(30, 40)}
    assert len(got) < 10 * 30


def test_one_id_with_several_texts(spark):
    texts = {"a": "one two three four five six seven eight nine ten eleven twelve", "b": "q w e r t y u i o p", "c": "z x c v b n m l k j", "d": "only here and there"}
    rows = [(1, texts["a"]), (2, texts["a"] + " more"), (2, texts["b"]), (3, texts["b"]), (5, texts["c"]), (9, texts["c"]), (9, texts["b"] + " p"), (7, texts["d"]), (7, texts["d"]), (8, "  "), (8, texts["d"]), (None, texts["d"])]
    for _ in range(2):
        rng = random.Random(len(rows))
        rng.shuffle(rows)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (3, 1, False), (5, 1, False), (9, 1, False), (7, 7, True), (8, 7, False), (None, None, False)} or {
            (r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(1, 1), (2, 1), (3, 1), (5, 1), (9, 1), (7, 7), (8, 7)}


@pytest.mark.parametrize("toxic", [[], [1, 1, 1], [0, 0, 0]])
def test_nothing_is_dropped_without_a_model(spark, tmp_path, toxic):
    docs = spark.createDataFrame([(i, f"text number {i}", "x") for i in range(30)] + [(None, None, "y")], "doc_id long, text string, score string")
    spark.createDataFrame([(i, None, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() == 31
    assert corpus_pipeline.drop_toxic(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_on_empty_tables_and_repeated_rows(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, label string, h string"
    rows = [(1, "a b c d e f g", "en", "s", 13, "x", "y"), (1, "a b c d e f g", "en", "s", 13, "x", "y"), (2, None, None, None, None, None, None), (None, "k", "en", "s", 1, "x", "y")]
    for name, some in (("none", []), ("some", rows)):
        spark.createDataFrame(some, kinds).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.count() == len(some) and {"ids", "n_tokens", "label", "h"} <= set(out.columns)


def test_quality_without_a_split(spark):
    docs = spark.createDataFrame([(i, "the same text", "s") for i in range(60)], "doc_id long, text string, s string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    scores = {r.score for r in quality.quality(docs, labels).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1
    for c in (0, 1):
        rows = quality.quality(docs, labels.withColumn("quality", F.lit(c))).collect()
        assert {r.predicted for r in rows} == {c} and all(abs(r.score - c) < 1e-9 for r in rows)


def test_scores_of_rules_are_recomputed(spark):
    """The compiled expression against the rules read in plain Python."""
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice(["ab", "Cde", "fghi", "12", "|", "lengthyandlonger", "ok!"]) for _ in range(rng.randrange(0, 40)))) for i in range(200)]
    rows = quality.statistics(spark.createDataFrame([(i, t, int("|" in t)) for i, t in texts], "doc_id long, text string, label int"), "doc_id", "label")
    constant, rules = quality.fit(rows)
    import math

    for r in rows.withColumn("score", quality.compiled(constant, rules)).collect():
        total = constant + sum(w for rule, w in rules if all((r.s[n] <= at) if side == "<=" else (r.s[n] > at) for n, side, at in rule))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9


def test_records_are_dealt_by_their_bytes(spark):
    rows = [(i, f"u{i}", "<p>" + f"{i} " * 400) for i in range(300)] + [(7, "again", "<p>" + "7 " * 400), (7, "twice", "long " * 60_000)]
    index = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), new_path(spark, "warc"))
    assert warc.dealt(index, slice_bytes=1 << 10, partition_bytes=4 << 10).rdd.getNumPartitions() > 4
    got = warc.read_records(warc.dealt(index, 1 << 10, 4 << 10)).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == sorted((i, len(h)) for i, _, h in rows)
    assert sum(r.record_type == "revisit" for r in got) == 0  # both rows of the largest page_id of a payload are responses


def test_repeats_beside_clashing_columns(spark):
    passage = "".join(chr(97 + (i * i + i // 5) % 26) for i in range(260))
    names = ["runs", "runs_of", "key", "removed", "kept", "seed", "row"]
    rows = [(1, "x" * 5 + passage, *"abcdefg"), (2, passage + "tail", *"abcdefg"), (2, passage + "tail", *"abcdefg"), (None, None, *"abcdefg")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "runs", "runs_of", "key", "seed", "row", "kept", "removed", "n_bytes"]
    assert sorted((r.doc_id or 0, bytes(r.kept), r.runs, r.row) for r in out.collect()) == [(0, b"", "a", "g"), (1, b"xxxxx", "a", "g"), (2, b"", "a", "g"), (2, b"", "a", "g")]
