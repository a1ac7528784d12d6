"""Scores of trained operators recomputed in plain Python, from texts or from the fitted tables."""

import collections
import math
import random

import numpy as np
import pytest

from lectern.llm import language_id, toxicity


def texts_of(seed, n):
    rng = random.Random(seed)
    usual, rude = ["the", "sea", "is", "calm", "and", "wide", "today", "here"], ["you", "vile", "moron", "go", "away"]
    out = []
    for i in range(n):
        toxic = int(i % 3 == 0)
        words = [rng.choice(usual) for _ in range(rng.randrange(3, 14))]
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rude[rng.randrange(3):]
        out.append((" ".join(words), toxic, rng.randrange(2)))
    return out


def test_kneser_ney_tables(spark):
    rows = texts_of(5, 90)
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int, part int"), least=1, context=1e-9)
    seen = {(c, part): set() for c in (0, 1) for part in (0, 1)}
    for text, c, part in rows:
        w = text.split()
        for i, x in enumerate(w):
            seen[c, part].add((w[i - 2] if i > 1 else "", w[i - 1] if i else "", x))
    pairs = {k: collections.Counter((v, w) for _, v, w in s) for k, s in seen.items()}
    ends = {k: collections.Counter(w for _, w in p) for k, p in pairs.items()}

    def discount(tables, c):
        n = collections.Counter(x for (own, _), t in tables.items() if own == c for x in t.values())
        return min(0.95, max(0.05, n[1] / max(1, n[1] + 2 * n[2])))

    def mean(c, f):
        return sum(f(c, part) for part in (0, 1)) / 2

    vocabulary = sorted({w for t in ends.values() for w in t})
    one, two = ({c: discount(t, c) for c in (0, 1)} for t in (ends, pairs))
    total = {c: mean(c, lambda c, q: sum(ends[c, q].values())) for c in (0, 1)}
    share = {w: sum(ends[k][w] for k in ends) for w in vocabulary}
    p = {}
    for c in (0, 1):
        cut = {w: mean(c, lambda c, q, w=w: max(0, ends[c, q][w] - one[c])) / total[c] for w in vocabulary}
        rest = 1 - sum(cut.values())
        p[c] = {w: cut[w] + rest * share[w] / sum(share.values()) for w in vocabulary}
        assert abs(sum(p[c].values()) - 1) < 1e-9
    assert set(model.ids) == set(vocabulary)
    for w in vocabulary:
        assert abs(model.uni[model.ids[w]] - math.log(p[1][w] / p[0][w])) < 1e-6

    def given(c, v, w):
        whole = mean(c, lambda c, q: sum(n for (x, _), n in pairs[c, q].items() if x == v))
        used = mean(c, lambda c, q: sum(max(0, n - two[c]) for (x, _), n in pairs[c, q].items() if x == v))
        return mean(c, lambda c, q: max(0, pairs[c, q][v, w] - two[c])) / whole + max(1 - used / whole, 0.01) * p[c][w]

    both = {v for v in vocabulary if all(any(x == v for q in (0, 1) for (x, _) in pairs[c, q]) for c in (0, 1))}
    size, found = len(model.uni), dict(zip(model.keys.tolist(), model.bi.tolist(), strict=True))
    assert len(found) == len({(v, w) for t in pairs.values() for v, w in t if v in both})
    for v, w in {k for t in pairs.values() for k in t if k[0] in both}:
        want = math.log(given(1, v, w) / given(0, v, w)) - math.log(p[1][w] / p[0][w])
        assert abs(found[model.ids[v] * size + model.ids[w]] - want) < 1e-6


def test_scores_by_hand(spark):
    rows = texts_of(6, 120)
    model = toxicity.fit(spark.createDataFrame([(t, c, q if i % 4 else None) for i, (t, c, q) in enumerate(rows)], "text string, toxic int, part int"), least=1, context=1)
    found = dict(zip(model.keys.tolist(), model.bi.tolist(), strict=True))
    some = [t for t, _, _ in rows[:20]] + [None, "", "...", "unseen words only", "The SEA, the sea! " * 5000]
    for text, got in zip(some, model.scores(some), strict=True):
        ids = [model.ids.get(w, 0) for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
        x = [model.uni[w] + (found.get(v * len(model.uni) + w, model.context[v]) if i else 0.0) for i, (v, w) in enumerate(zip([0, *ids], ids))]
        features = [0.0, 0.0, math.log(toxicity.FLOOR)]
        if x:
            run = min(8, len(x))
            features = [sum(x) / len(x), max(sum(x[i : i + run]) for i in range(len(x) - run + 1)) / 8, math.log(toxicity.FLOOR + sum(max(0, v - toxicity.EXCESS) for v in x) / len(x))]
        total = model.weights[0] + sum(w * f for w, f in zip(model.weights[1:], features, strict=True))
        assert abs(got - 1 / (1 + math.exp(-total))) < 1e-6


def test_language_scores_by_hand(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en"), ("the dog", "en"), ("el perro y el gato", "es"), ("die katze", "de")] * 3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    languages = ["de", "en", "es"]
    words, grams = ({x: collections.Counter() for x in languages} for _ in range(2))
    for _, text, lang in rows:
        for w in text.split():
            words[lang][w] += 1
            padded = f"\x02{w}\x03"
            for k in (4, 3, 2, 1):
                for i in range(max(1, len(padded) - k + 1)):
                    grams[lang][padded[i : i + k]] += 1
    all_words, all_grams = ({x for c in t.values() for x in c} for t in (words, grams))

    def row(counts, x, same, per):
        out = {lang: math.log((counts[lang][x] + 0.5) / (sum(counts[lang][y] for y in same) + 0.5 * len(same))) / per for lang in languages}
        return {lang: v - max(out.values()) for lang, v in out.items()}

    for text in ["the dog und die katze", "hundkatze", "perros", "xyzzy the", "q", "der the"]:
        total, own = dict.fromkeys(languages, 0.0), text.split()
        for w in own:
            if w in all_words:
                add = [row(words, w, all_words, 1)]
            else:
                padded, add = f"\x02{w}\x03", []
                for k in (4, 3, 2, 1):
                    add = [row(grams, g, {y for y in all_grams if len(y) == k}, k) for i in range(max(1, len(padded) - k + 1)) if (g := padded[i : i + k]) in all_grams]
                    if add:
                        break
            for r in add:
                for lang in languages:
                    total[lang] += r[lang]
        top = max(total.values())
        e = {lang: math.exp(v - top) for lang, v in total.items()}
        want = min(lang for lang in languages if total[lang] == top)
        got, score = model.predict(text)
        assert got == want and abs(score - e[want] / sum(e.values())) < 1e-5


def test_ties_and_long_texts_of_languages(spark):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["fr", "de", "fr", "de"])]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("same words") == ("de", pytest.approx(0.5)) and model.predict("same " * 100_000)[0] == "de"
    assert np.isfinite(model.rows).all()
