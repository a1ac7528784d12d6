"""Decontamination against a double loop over documents and items in plain Python, and odd cases."""

import collections
import itertools
import random
import re
import time

from lectern.llm import decontamination as D

N, COVER = 5, 0.5


def tokens(text):
    out, start, number = [], True, False
    for raw in (text or "").split():
        word = raw.strip(D.EDGE)
        if not word:
            continue
        low = word.casefold()
        digits = bool(re.fullmatch(r"[+-]?\d[\d.,:/]*(%|[^\W\d_]{1,3}[²³]?)?", word))
        unit = number and (low in D.UNITS or bool(re.fullmatch(r"[^\W\d_]{1,3}[²³]?(/[^\W\d_]{1,4}[²³]?)?", low)))
        name = word[0].isupper() and not word.isupper()
        kind = 1 if digits else 2 if unit else 3 if name and not start else 0
        out.append((low, kind, 3 if kind == 0 and name and start else kind))
        start, number = raw[-1] in ".!?" or raw[-2:-1] in (".", "!", "?"), digits
    return out


def posted(words, size):
    """(place, form as a tuple, the kinds of its slots) of all windows."""
    for i in range(len(words) - size + 1):
        w = words[i : i + size]
        plain = tuple(x for x, _, _ in w)
        template = tuple((k,) if k else x for x, k, _ in w)
        third = tuple((k,) if k else x for x, _, k in w)
        kinds = [k for _, k, _ in w]
        yield i, plain, kinds if kinds.count(0) >= 2 else [0] * size
        if template != plain and sum(1 for _, k, _ in w if not k) >= 2:
            yield i, template, kinds
        if size == N and third not in (template, plain) and sum(1 for _, _, k in w if not k) >= 2:
            yield i, third, [k for _, _, k in w]


def leak(doc, item):
    """(covered, windows, reworded) or None."""
    x, y = tokens(item), tokens(doc)
    if not x:
        return None
    size = min(N, len(x))
    own = collections.defaultdict(set)
    for at, form, _ in posted(y, size):
        own[form].add(at)
    chains = collections.defaultdict(set)
    times = collections.Counter(form for _, form, _ in posted(x, size))
    free = set()
    for pos, form, kinds in posted(x, size):
        if times[form] > 1 and not any(kinds):
            free |= {pos} if own[form] else set()
            continue
        for at in own[form]:
            slots = tuple((x[pos + i][0], y[at + i][0], k, pos + i) for i, k in enumerate(kinds) if k)
            chains[at - pos].add((pos, slots))
    covered, reworded = set(), []
    for windows in chains.values():
        placed = {s for _, slots in windows for s in slots}
        same = {s[0] for s in placed if s[0] == s[1]}
        if any(s[2] == 1 and s[0] != s[1] and s[0] in same for s in placed):
            continue
        kinds = {(a, b, k) for a, b, k, _ in placed}
        by = collections.defaultdict(set)
        for a, b, k in kinds:
            by[a].add((b, k))
        lost = set()
        if any(len(v) > 1 for v in by.values()):
            for a, v in by.items():
                ranked = sorted((-sum(1 for s in placed if s[:2] == (a, b)), a != b, b) for b, _ in v)
                lost |= {(a, b) for _, _, b in ranked if b != ranked[0][2]}
        held = [(pos, slots) for pos, slots in windows if not any(s[:2] in lost for s in slots)]
        if held:
            covered |= {pos for pos, _ in held}
            reworded.append(any(s[0] != s[1] for _, slots in held for s in slots))
    covered |= free
    total = len(x) - size + 1
    need = max(1, -(-total * 50 // 100))
    return (len(covered), total, min(reworded, default=False)) if len(covered) >= need else None


def got(spark, docs, items):
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(docs)], "doc_id long, text string, h string")
    items = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, pos int")
    return {(r.doc_id, r.item_id): (r.covered, r.n_windows, r.reworded) for r in D.leaks(docs, items).collect()}


def test_against_a_double_loop(spark):
    rng = random.Random(9)
    words = "the a of red old man ship Avon Bath Kim Max went sold took 3 7 12 25 kg km and with by Then".split()
    line = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", "", ".", ",", "?"]) for _ in range(n))
    items = [line(rng.choice([1, 3, 4, 5, 6, 9, 15, 30])) for _ in range(40)] + ["", None, "...", "Kim sold 3 kg."]
    docs = []
    for _ in range(160):
        item = rng.choice(items) or ""
        change = {w: rng.choice(words) for w in rng.sample(words, 3)}
        own = " ".join(change.get(w, w) for w in item.split(" ")) if rng.random() < 0.7 else item
        docs.append(f"{line(rng.randrange(0, 20))} {own.upper() if rng.random() < 0.1 else own} {line(rng.randrange(0, 20))}")
    items += ["red old ship red old ship went sold red old ship went sold took", "the the the the the the the the of"]
    docs += ["", None, " \n ", *[i for i in items if i], "the " * 40 + "of", "red old ship went sold red old ship went sold"]
    want = {(d, i): found for (d, doc), (i, item) in itertools.product(enumerate(docs), enumerate(items)) if (found := leak(doc, item))}
    assert got(spark, docs, items) == want and len(want) > 200 and any(r for _, _, r in want.values())


def test_names_at_sentence_starts(spark):
    item = "Maria bought 7 pens. John bought 9 pens. Peter sold 4 pens. Who has more pens now"
    doc = "Laura bought 8 pens. Steve bought 6 pens. Frank sold 3 pens. Who has more pens now"
    assert got(spark, [doc, "Sailors know the sea. Farmers know 3 fields. Nobody sold the old pens"], [item]) == {(0, 0): (13, 13, True)}
    assert got(spark, ["Ann wrote Macbeth?", "He sold 3 old pens. Some went away"], ["Who wrote Hamlet?", item]) == {}


def test_units_by_pattern(spark):
    item = "a tank that holds 250 hl of oil is filled at 3 m³/s by pumps"
    assert got(spark, [item.replace("250 hl", "70 gal").replace("3 m³/s", "9 ft³/s")], [item]) == {(0, 0): (11, 11, True)}


def test_very_long_texts(spark):
    item = "In 1999 the river Avon carried 25 kg of sand past Bristol"
    assert got(spark, ["word " * 300_000 + item + " other" * 100_000], [item]) == {(0, 0): (8, 8, False)}


def test_numbers_alone_are_no_evidence(spark):
    """Runs of slots match by their own words only."""
    table = " ".join(str(i) for i in range(20))
    items = ["Add 12 35 48 91 22", " ".join(str(900 + 7 * i) for i in range(10)), "Ann Bob Kim Max Joe Eve Tom", table]
    docs = ["The measured results were 1 2 3 4 5 in that order", table, "then came Ida Leo Uwe Pia Jan Kai Ben", "so 12 35 48 91 22 it is", "3 kg 4 kg 5 kg 6 kg"]
    assert got(spark, docs, items) == {(1, 3): (16, 16, False), (3, 0): (1, 2, False)}


def test_tables_of_numbers_take_seconds(spark):
    rng = random.Random(4)
    numbers = lambda n: " ".join(str(rng.randrange(10)) for _ in range(n))
    item = "Sum up " + numbers(100)
    began = time.time()
    assert got(spark, [numbers(5000), "word " + numbers(5000), "1 " * 5000, item], [item, "1 " * 100]) == {(2, 1): (96, 96, False), (3, 0): (98, 98, False)}
    assert time.time() - began < 60
