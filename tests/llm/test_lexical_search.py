"""Ranked search against scores of all documents, the treaps' orders, and that ranges are pruned."""

import collections
import math
import random
import re

import numpy as np
import pytest

from lectern.llm import lexical_search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    tf = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs]
    tf = [x for x in tf if x[2]]
    count, length = len(tf), sum(n for _, _, n in tf)
    df = collections.Counter(t for _, c, _ in tf for t in c)
    asks = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asks[i] |= set(terms(t))
    out = []
    for item, own in asks.items():
        found = []
        for i, c, n in tf:
            m = 100 - 50 + 50 * n * count // length
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0 and i is not None:
                found.append((-s, i))
        out += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def asked(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n int, terms string").repartition(3)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, term string")
    return sorted(tuple(r) for r in lexical_search.ranked(d, i, **more).select("item_id", "rank", "doc_id", "score").collect())


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["Ünï", "ünï", "A1", "漢字", "it's"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 80)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12))).upper()) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("blocks", [{}, {"POSTINGS": 900, "ITEM_TERMS": 60, "LEAF": 4, "RANGES": 3}])
def test_against_all_documents(spark, monkeypatch, blocks):
    for name, value in blocks.items():
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = corpus(500)
    docs += [(i, docs[7][1]) for i in range(600, 900)] + [(7, docs[7][1]), (None, docs[7][1]), (1000, None), (1001, ""), (1002, "... !"), (1003, "w1 " * 50_000)]
    items += [(50, docs[7][1]), (51, None), (52, "nowhere"), (None, "w1"), (0, "w3 w4")]
    assert asked(spark, docs, items) == brute(docs, items)
    assert asked(spark, docs, items, k=3) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus(5)
    assert asked(spark, [], items) == asked(spark, docs, []) == asked(spark, [(1, None)], items) == []


def test_treaps_keep_both_orders():
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 5 * 300, 900))
    t = lexical_search.Treaps(key // 300, key % 300, rng.integers(1, 9, len(key)), 300)
    seen = []

    def walk(node, low, high):
        if node >= 0:
            assert low <= t.doc[node] < high and all(t.impact[c] <= t.impact[node] and t.term[c] == t.term[node] for c in (t.left[node], t.right[node]) if c >= 0)
            walk(t.left[node], low, t.doc[node])
            seen.append(node)
            walk(t.right[node], t.doc[node] + 1, high)

    for root in t.root.values():
        walk(root, 0, 300)
    assert sorted(seen) == list(range(len(key)))
    for low, high in ((0, 150), (40, 41), (150, 300)):
        for term, root in t.root.items():
            own = np.flatnonzero((t.term == term) & (t.doc >= low) & (t.doc < high))
            (top,) = t.within(np.array([root]), np.array([low]), np.array([high]))
            assert (top < 0) if not len(own) else t.impact[top] == t.impact[own].max()


def test_ranges_are_pruned():
    """With few documents of high impact, most are never scored."""
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 4 * 20_000, 30_000))
    impact = rng.integers(1, 100, len(key))
    impact[rng.integers(0, len(key), 60)] = 10_000
    t = lexical_search.Treaps(key // 20_000, key % 20_000, impact, 20_000)
    scores = np.zeros(20_000, np.int64)
    found, own, seen = lexical_search.searched(t, np.arange(4), 10, scores, leaf=16)
    every = np.bincount(t.doc, t.impact, 20_000).astype(np.int64)
    want = np.lexsort((np.arange(20_000), -every))[:10]
    assert found.tolist() == want.tolist() and own.tolist() == every[want].tolist() and seen < 3_000 and not scores.any()


def test_falling_impacts_make_no_long_walks():
    """All impacts alike: trees stay low."""
    t = lexical_search.Treaps(np.zeros(1 << 14, np.int64), np.arange(1 << 14), np.ones(1 << 14, np.int64), 1 << 14)
    depth, level = 0, np.array([t.root[0]])
    while len(level):
        level = np.concatenate([t.left[level], t.right[level]])
        level, depth = level[level >= 0], depth + 1
    assert depth < 60
