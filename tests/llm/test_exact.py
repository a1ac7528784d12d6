"""Operators with an exact answer, against brute force."""

import collections
import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import arrow_text as A
from lectern.llm import bpe, chat_format, components, minhash, permutation_index, suffix_dedup, warc
from lectern.llm.shared import new_path

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def reference_tokenizer():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a [INST] </s> [\\INST]"), (1, 1, "user", "b"), (1, 2, "assistant", "<\\/s>\\"), (1, 3, "tool", None), (2, 0, None, "x"), (2, 0, "assistant", "[SEP"), (2, 0, "assistant", "[SEP"), (None, 1, "system", "")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = chat_format.chat_format(df).withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("segments"))).collect()
    want = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == dict(want)
    assert {r.conv_id: r.loss for r in out} == {c: "".join(x for r, x in t if r == "assistant") for c, t in want.items()}
    assert [len(r.blocks) for r in out if r.conv_id == 1] == [3]
    assert chat_format.chat_format(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "'s", "'re", "é", "1", "漢", "!", "<|endoftext|>", "the ", "　", "xyz" * 9]), max_size=120))
def test_bpe_small_chunks_are_exact(parts):
    text = "".join(parts)
    encoding = bpe.vocabulary(VOCABULARY)[0]
    old = bpe.CHUNK_BITS, bpe.CHUNK_MIN, bpe.CHUNK_MAX
    bpe.CHUNK_BITS, bpe.CHUNK_MIN, bpe.CHUNK_MAX = 3, 16, 48
    try:
        got = bpe.encode_batch(*A.text_buffers(pa.array([text, None])), lambda s: encoding.encode_to_numpy(s, allowed_special="all"), {})
    finally:
        bpe.CHUNK_BITS, bpe.CHUNK_MIN, bpe.CHUNK_MAX = old
    assert got[0].tolist() == reference_tokenizer().encode(text, add_special_tokens=False).ids
    assert not len(got[1])


def test_bpe_round_trip(docs):
    tokenizer = reference_tokenizer()
    out = bpe.round_trip(docs, VOCABULARY).collect()
    assert len(out) == docs.count()
    for r in out:
        want = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == tokenizer.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), VOCABULARY).count() == 0


def test_bpe_decodes_broken_sequences(spark):
    ids = reference_tokenizer().encode("漢", add_special_tokens=False).ids
    df = spark.createDataFrame([(ids[:1],), (ids,), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df, VOCABULARY).collect()] == ["�", "漢", "", ""]


def shingle_set(text, n):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c.lower() if c.isascii() else c for c in text or "").split(" ") if w]
    return {tuple(words)} if 0 < len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_components(rows, n, percent=80):
    sets = {i: shingle_set(t, n) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, n):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    label, sizes = brute_components([r for r in rows if r[0] is not None], n)
    got = minhash.near_duplicates(docs, words=n).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got if r.doc_id is not None} == {i: (label[i], sizes[i], label[i] == i) for i in label}
    assert minhash.near_duplicates(docs.limit(0), words=n).count() == 0


def test_near_copies_around_the_threshold(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(4):
        base = [rng.choice(words) for _ in range(90)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randrange(0, 8)):
                own[rng.randrange(90)] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    label, _ = brute_components(rows, 2)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == label
    assert len(set(label.values())) > 4


def test_families_are_compared_in_blocks(spark):
    a, b = "a b c d e f g h i j k l", "a b c d e f g h i j k x"
    texts = spark.createDataFrame([(i, a if i % 2 else b) for i in range(40)], "doc_id long, text string")
    every = texts.select("doc_id", F.when(F.col("doc_id") < 30, 0).otherwise(F.col("doc_id")).cast("long").alias("label"))
    apart = every.where("label > 0").select(F.lit(0).cast("long").alias("family"), "doc_id")
    got = {(r.a, r.b) for r in minhash.confirm_families(apart, every, texts, 2, 80, block=4).collect()}
    want = {(x, y) for x in range(40) for y in range(max(30, x + 1), 40)}
    assert got == want


def test_components_of_a_chain(spark):
    rows = [(i, i + 1) for i in range(1, 30)] + [(50, 60), (60, 50), (50, 70)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {50: 50, 60: 50, 70: 50}


def test_run_length_index_marks_what_brute_force_marks():
    rng = random.Random(3)
    for length in (16, 20, 33) * 8:
        base = [bytes(rng.choices(b"ab", k=90)) for _ in range(3)]
        contexts, before = [], []
        for _ in range(25):
            own = bytearray(rng.choice(base))
            for _ in range(rng.choice([0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(b"abc")
            left = rng.randint(0, 20)
            contexts.append(bytes(own[left : rng.randint(70, 90)]))
            before.append(40 - left)
        seen = collections.Counter((a - q, c[a : a + length]) for c, q in zip(contexts, before) for a in range(len(c) - length + 1))
        want = [suffix_dedup._runs(np.array([a for a in range(len(c) - length + 1) if seen[a - q, c[a : a + length]] > 1], int), length) for c, q in zip(contexts, before)]
        assert suffix_dedup.marked(contexts, before, length) == want


def brute_removal(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        runs = suffix_dedup._runs(np.array([i for i in range(len(raw) - length + 1) if seen[raw[i : i + length]] > 1], int), length)
        runs = suffix_dedup._united([{"s": s, "e": e} for s, e in runs])
        at, kept = 0, b""
        for s, e in runs:
            kept, at = kept + raw[at:s], e
        out.append((len(raw), runs, kept + raw[at:]))
    return out


@pytest.mark.parametrize("most", [4096, 1])
def test_repeats_are_removed(docs, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    texts = [r.text for r in docs.collect()]
    want = sorted((n, [list(r) for r in runs], kept) for n, runs, kept in brute_removal(texts, 200))
    got = sorted((r.n_bytes, r.removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == want
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_rows_whose_hashes_agree_are_told_apart(docs, monkeypatch):
    whole = suffix_dedup.hashed
    monkeypatch.setattr(suffix_dedup, "hashed", lambda rows, salt: F.pmod(whole(rows, salt), F.lit(3 if salt == 0 else 5)) if salt in (0, 1) else whole(rows, salt))
    rows = docs.select("doc_id", "text").distinct()
    assert rows.select(suffix_dedup.identity(rows)).distinct().count() == rows.count()
    want = sorted((n, [list(r) for r in runs], kept) for n, runs, kept in brute_removal([r.text for r in docs.collect()], 200))
    assert sorted((r.n_bytes, r.removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()) == want


def test_whole_characters_stay(spark):
    texts = ["é" * 150 + "a", "b" + "é" * 150]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), whole_characters=True).collect()
    for r in out:
        bytes(r.kept).decode()


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).round(1)
    x[50:150] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] + [1.0] * 7), (904, [1.0, 2.0]), (905, [float("inf")] * 8), (906, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in permutation_index.nearest(df, F.col("vec_id") % 20 == 0, k=20, index_block=150, query_block=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 400, 20):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        want = np.lexsort((np.arange(400), -score))[:20]
        hits += len({v for v, _ in got[q]} & set(want.tolist()))
        total += 20
        assert [round(s, 9) for _, s in got[q]] == [round(float(score[v]), 9) for v, _ in got[q]]
    assert set(got) == set(range(0, 400, 20)) and hits / total >= 0.9


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "ü" * 600
    rows = [(1, "http://a b", big), (2, None, big), (3, "x", None), (4, "y", ""), (5, "z", "small"), (6, "z", "small"), (9, "q", big), (None, "n", "no id"), (10, "crlf", "a\r\n\r\nb\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    index = warc.archive(df, new_path(spark, "warc"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index).collect()}
    top = {h: max(p for p, _, g in rows if g == h and p) for h in (big,)}
    want = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        copy = len(raw) >= 1000 and top.get(html) != page
        want[page] = (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if copy else "response", top[html] if copy else None)
    assert got == want
    assert warc.archive(df.limit(0), new_path(spark, "warc")).count() == 0


def test_monolithic_streams_of_several_members():
    import gzip
    import io

    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc.records(warc.inflated(io.BytesIO(gzip.compress(record * 3) + gzip.compress(record))))) == [record] * 4
