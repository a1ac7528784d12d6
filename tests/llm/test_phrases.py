"""Collocations against counting in plain Python, and the perfect hash against a dict."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import perfect_hash, phrases


def brute(rows, least, longest=5, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        inside = any(g == lang and len(v) > len(w) and 100 * b >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), b in found.items())
        if inside:
            continue
        score, k, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def rows_for(seed):
    rng = random.Random(seed)
    words = ["ha", "Ha", "the", "of", "b", "ñu", "漢", "x\x00y", "won't", "cat", "dog", "\xa0", "A-B", "und"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(rng.randrange(60)))) for _ in range(120)]
    return rows + [("en", "ha " * 500), ("en", None), (None, ""), ("en", " .,;\n"), ("fr", "one two three four five six. " * 12), ("fr", "ha " * 30_000), ("en", rows[0][1]), ("en", rows[0][1])]


def asked(df, **more):
    return sorted(tuple(r) for r in phrases.collocations(df, **more).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_counting(spark, seed):
    rows = rows_for(seed)
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "lang string, text string, a int, slot string").repartition(3)
    assert asked(df, least=10) == brute(rows, 10)
    assert asked(df, least=3, top=5) == brute(rows, 3, top=5)


def test_many_groups_of_shards(spark, monkeypatch):
    rows = rows_for(3)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = brute(rows, 3)
    monkeypatch.setattr(perfect_hash, "SHARD", 20)
    monkeypatch.setattr(perfect_hash, "ARITY", 2)
    assert asked(df, least=3) == want


def test_full_bins(spark, monkeypatch):
    # At 6 GB all bins hold enough: candidates were all pairs of frequent parts, and each task went through the hashes of all of them.
    rows = rows_for(4)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    build, sizes = perfect_hash.build, []

    def built(keys, *extra):
        sizes.append(keys.count())
        return build(keys, *extra)

    monkeypatch.setattr(phrases, "bin_bits", lambda bins, least: np.full(1 << (phrases.BINS - 3), 255, np.uint8))
    monkeypatch.setattr(phrases, "WORDS", 300)
    monkeypatch.setattr(perfect_hash, "ARITY", 2)
    monkeypatch.setattr(perfect_hash, "build", built)
    levels, _ = phrases.frequent(df, 4)
    assert sizes == [level.count() for level in levels] and sizes[1] > 20
    assert asked(df, least=4) == brute(rows, 4)


def test_sums_of_pairs():
    rng = np.random.default_rng(7)
    for low, high in ((0, 9), (0, 1 << 20), ((1 << 40) - 5, 1 << 40)):
        p, q, n = rng.integers(low, high, 3000), rng.integers(low, high, 3000), rng.integers(1, 50, 3000)
        want = {}
        for a, b, c in zip(p.tolist(), q.tolist(), n.tolist(), strict=True):
            want[a, b] = want.get((a, b), 0) + c
        a, b, c = (x.tolist() for x in phrases.summed(p, q, n))
        assert list(zip(a, b, strict=True)) == sorted(want) and dict(zip(zip(a, b, strict=True), c, strict=True)) == want
    assert [len(x) for x in phrases.summed(*(np.zeros(0, np.int64),) * 3)] == [0, 0, 0]


def test_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13, 10**15, [10**6], [10**8])], "a bigint, n bigint, lefts array<bigint>, rights array<bigint>")
    got = df.select(F.expr("(cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0))) div (cast(lefts[0] as decimal(38,0)) * cast(rights[0] as decimal(38,0)))").alias("x")).first().x
    assert got == 1000 * 10**13 * 10**15 // 10**14


def test_no_rows(spark):
    none = spark.createDataFrame([], "lang string, text string, doc_id long")
    assert asked(none) == []
    assert asked(spark.createDataFrame([("en", "a b")], none.select("lang", "text").schema)) == []
    assert phrases.collocations(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    sizes, bits, slot = perfect_hash.perfect(h)
    assert sorted(slot.tolist()) == list(range(5000)) and 64 * len(bits) == sum(sizes)


def test_stored_keys_tell_strangers(spark):
    rng = np.random.default_rng(5)
    known = {(int(a), int(b)) for a, b in rng.integers(-50, 1 << 40, (3000, 2))}
    df = spark.createDataFrame(sorted(known), "p bigint, q bigint")
    rows, n = perfect_hash.build(df)
    slots = {(r.p, r.q): r.slot for r in perfect_hash.keys_by_slot(rows).collect()}
    assert set(slots) == known and len(set(slots.values())) == len(known)
    asks = np.array(sorted(known) + [(a, b + 1) for a, b in sorted(known) if (a, b + 1) not in known])
    got = perfect_hash.Reader(rows.written_to, n).slots(asks[:, 0], asks[:, 1], perfect_hash.pair_hash(asks[:, 0], asks[:, 1]))
    assert got.tolist() == [slots.get(tuple(map(int, k)), -1) for k in asks]
