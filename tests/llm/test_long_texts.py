"""Very long texts, repeated ids and odd letters, operator by operator."""

import hashlib

from pyspark.sql import functions as F

from lectern.llm import chat_format, language_id, quality, warc
from lectern.llm.shared import new_path


def test_long_turns_are_read_back(spark):
    text = "</s>[INST] \\ <s> [/INST] é漢 \n" * 20_000
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "assistant", None), (2, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    out = chat_format.chat_format(rows).withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("segments")))
    got = {r.conv_id: r for r in out.collect()}
    assert "".join(t.text for t in got[1].turns if t.role == "user") == text and "".join(t.text for t in got[1].turns if t.role == "assistant") == text
    assert got[1].loss == text and got[2].loss == ""


def test_long_and_repeated_pages(spark):
    long = "<p>ñ" * 600_000
    rows = [(1, "u", long), (5, "u", long), (5, "u", long), (5, "v", "small"), (7, None, "small"), (9, "w", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_records(warc.dealt(warc.archive(pages, new_path(spark, "warc")))).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got if r.payload_bytes > 1000) == [(1, len(long.encode()), "revisit", 5), (5, len(long.encode()), "response", None), (5, len(long.encode()), "response", None)]
    assert {r.payload_digest for r in got if r.payload_bytes > 1000} == {hashlib.sha1(long.encode()).hexdigest()}
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got if r.payload_bytes < 1000) == [(5, 5, "response"), (7, 5, "response"), (9, 0, "response")]


def test_quality_of_a_long_text(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, ("good words here and there " if i % 2 else "bad!!! ") * (5 + i % 7)) for i in range(60)] + [(100, "good words here and there " * 60_000), (101, None), (102, "")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert len(got) == 63 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_letters_that_change_when_they_are_folded(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("İstanbul şehri büyük", "tr"), ("STRAẞE und Straße", "de")] * 30)] + [(900, "İ ẞ", None), (901, "123 !", None), (902, None, "tr")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == 63 and got[901][0] == got[902][0] == "und" and {p for p, _ in got.values()} <= {"tr", "de", "und"}
    assert all(got[i][0] == ("tr", "de")[i % 2] for i in range(60))
