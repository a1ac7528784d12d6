"""Trained operators by held-out results, decontamination and the pipeline by planted cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import decontamination, language_id, quality, toxicity

SF01 = "/root/testdata/sf0.1"
need = pytest.mark.skipif(not os.path.isdir(SF01), reason="no test data")


@need
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    caught, wrong = rows.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert caught >= 0.9 and wrong <= 0.02
    rows = quality.quality(docs, labels).join(labels, "doc_id").where("held_out")
    assert rows.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] >= 0.97
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


def test_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (6, None, None), (8, 1, 0), (9, 0, 1), (10, 1, 0), (12, 0, 1)], "doc_id long, quality int, toxic int")
    for out in (toxicity.toxicity(docs, labels), quality.quality(docs, labels), toxicity.toxicity(docs, labels.limit(0)), quality.quality(docs, labels.limit(0))):
        rows = out.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    found = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert found[3] == found[4] == found[5] == "und"
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_rules_are_compiled(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(["ab", "cde", "fghi"]) for _ in range(30)) + ("!!" * 20 if i % 3 == 0 else ""), int(i % 3 != 0)) for i in range(300)]
    stats = quality.statistics(spark.createDataFrame(rows, "text string, label int"), "label")
    constant, rules = quality.fit(stats)
    assert rules
    scored = stats.withColumn("score", quality.compiled(constant, rules))
    assert scored.where((F.col("score") >= 0.5).cast("int") != F.col("label")).count() == 0


def test_templates_and_slots(spark):
    item = "In 1999 the river Avon carried 25 kg of sand past Bristol and then 25 kg of clay past Bath every single day"
    same = "x y z " + item + " and more"
    moved = "well " + item.replace("1999", "2004").replace("25 kg", "31 lb").replace("Avon", "Rhine").replace("Bristol", "Basel").replace("Bath", "Bonn")
    broken = "well " + item.replace("then 25 kg", "then 99 kg")
    cased = item.upper() + "!!"
    rows = [(1, same), (2, moved), (3, broken), (4, "nothing of the kind is said here at all " * 5), (5, None), (6, ""), (7, same), (7, same), (8, "a tiny item here"), (9, cased)]
    docs = spark.createDataFrame([(*r, "h") for r in rows], "doc_id long, text string, h string")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reworded for r in decontamination.leaks(docs, items).collect()}
    assert got[1, 1] is False and got[2, 1] is True and got[7, 1] is False and got[8, 4] is False
    assert not any(d in (4, 5, 6) for d, _ in got)
    assert (3, 1) not in got
    assert sorted(r.doc_id for r in decontamination.decontaminated(docs, items).collect())[0] in (3, 4)
    assert decontamination.leaks(docs.limit(0), items).count() == 0
    assert decontamination.leaks(docs, items.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "ka lo mi nu re so ti va".split() for b in "bel dor fin gam hul jin".split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, item = text(80), text(60), text(30)
    rows = [(1, base), (2, base), (3, text(40) + " " + passage + " " + text(40)), (4, text(50) + " " + passage), (5, text(30) + " " + item + " " + text(30)), (6, text(70)), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [1, 3, 4, 6, 7, 8]
    assert passage not in out[3].text and passage not in out[4].text and len(out[3].text) < 600
    assert out[6].text == dict(rows)[6] and out[6].n_tokens == len(out[6].ids) and out[7].text is None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
