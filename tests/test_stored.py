"""Versions, the stored index, saved queries, names, hierarchies, the journal, cleanups, tasks, seeds and content keys."""

import collections
import datetime
import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import cleanup, hierarchy, journal, names, search_index, tasks
from lectern.operators import saved_queries as Q
from lectern.sources import formats, seeds
from lectern.sources.versions import Conflict, Versioned


@pytest.fixture
def store(spark, tmp_path):
    return Versioned(spark, f"file://{tmp_path}/store")


def test_versions_commit_whole_or_not_at_all(spark, store, monkeypatch):
    assert store.read() is None and store.number() == 0
    assert store.write(rows=spark.range(3)) == 1
    with monkeypatch.context() as broken:
        broken.setattr(Versioned, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost between write and commit")))
        with pytest.raises(RuntimeError):
            store.write(rows=spark.range(9))
    assert store.number() == 1 and store.read().count() == 3
    assert store.write(rows=spark.range(5)) == 2 and store.read().count() == 5 and store.read(number=1).count() == 3
    late = store.stage()
    spark.range(7).write.parquet(f"{store.folder}/{late}/rows")
    with pytest.raises(Conflict):
        store.commit(late, 1)
    assert store.read().count() == 5
    assert len(store.tidy(keep=1)) == 3 and store.read().count() == 5


TEXTS = [(1, "The cat sat. The end", "B"), (2, "a Cat and a dog", "a"), (3, "Café, category; caterpillar!", "c"), (4, None, "d"), (5, "the the the cat", "A"), (6, "nothing here", None)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(TEXTS, "id long, text string, title string")
    out = Versioned(spark, f"file://{tmp_path_factory.mktemp('index')}/i")
    search_index.build(out, docs, "id", ["text"], "title", F.col("id") == 5)
    return out


def test_index_finds_words_and_prefixes(index):
    ids = lambda rows: sorted(r.key for r in rows.collect())
    assert ids(search_index.match(index, ["cat"])) == [1, 2, 5]
    assert ids(search_index.match(index, ["cat"], live=True)) == [1, 2]
    assert ids(search_index.match(index, ["the", "cat"])) == [1, 5]
    assert ids(search_index.match(index, ["cat"], prefix=True)) == [1, 2, 3, 5]
    assert ids(search_index.match(index, ["ca", "cat"], prefix=True)) == [1, 2, 3, 5]
    assert ids(search_index.match(index, ["cafe"])) == [3] and ids(search_index.match(index, ["cat", "nowhere"])) == []
    assert search_index.total(index, ["cat"], live=True).first().total == 2


def test_index_pages(index, spark):
    first = search_index.page(index, ["cat"], limit=2).collect()
    assert [r.total for r in first] == [3, 3] and not any(r.fuzzy for r in first)
    rest = search_index.page(index, ["cat"], limit=2, offset=2).collect()
    assert sorted(r.key for r in first + rest) == [1, 2, 5]
    docs = spark.createDataFrame(TEXTS, "id long, text string, title string")
    near = search_index.page(index, ["cate"], docs=docs, key="id", columns=("text",), phrase="CATE").collect()
    assert [(r.key, r.fuzzy, r.total) for r in near] == [(3, True, 0)]
    assert search_index.page(index, ["og"], docs=docs, key="id", columns=("text",), phrase="og").count() == 0


def test_a_query_reads_its_buckets_and_no_text(index):
    plan = search_index.match(index, ["cat"])._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters")[1][:200] and "EqualTo(term,cat)" in plan and "split(" not in plan


def book(i, title="T", language="en", minutes=60, author="A", series=None, abridged=None, day=1, gone=False):
    at = datetime.datetime(2020, 1, 1) + datetime.timedelta(days=day)
    return (i, title, language, minutes * 60_000, author, series, abridged, at, at if gone else None)


def test_saved_queries(spark):
    rows = spark.createDataFrame(
        [book(i, f"Book {i % 7}", "en" if i % 2 else "de", i, f"O'Neil_{i % 3}", None, i % 4 == 0, i, i % 10 == 9) for i in range(60)],
        "book_id long, title string, language string, duration_ms long, author string, series string, abridged boolean, created_at timestamp_ntz, deleted_at timestamp_ntz")
    stored = spark.createDataFrame([
        (1, '{"q":"book 3"}', None), (2, '{"language":["de"],"limit":3,"offset":2,"sort":{"dim":"title","dir":"desc"}}', None), (3, '{"sort":{"dim":"title","dir":"asc"},"limit":4}', '{"dim":"imported_at","dir":"desc"}'),
        (4, '{"colour":1}', None), (5, '{"q":', None), (6, '{"limit":"many"}', None), (7, "{}", '{"dim":"price","dir":"asc"}'), (8, '{"author":"l_2","include_deleted":true}', None), (9, '{"series":"x"}', None), (10, None, None), (11, "[]", None),
        (12, '{"min_duration_secs":600,"max_duration_secs":1200,"abridged":false}', None), (13, '{"author":"%neil_1"}', None),
    ], "query_id long, query_json string, sort_json string")
    parsed = Q.parsed(stored)
    assert sorted(r.query_id for r in parsed.where("valid").collect()) == [1, 2, 3, 8, 9, 12, 13]
    live = [i for i in range(60) if i % 10 != 9]
    got = {r.query_id: r.total for r in Q.counted(rows, parsed).collect()}
    assert got == {1: sum(i % 7 == 3 for i in live), 2: sum(i % 2 == 0 for i in live), 3: len(live), 4: None, 5: None, 6: None, 7: None, 8: 20, 9: 0, 10: None, 11: None, 12: sum(10 <= i <= 20 and i % 4 != 0 for i in live), 13: sum(i % 3 == 1 for i in live)}
    page = collections.defaultdict(list)
    for r in sorted(Q.executed(rows, parsed).collect(), key=lambda r: (r.query_id, r.place)):
        page[r.query_id].append(r.book_id)
    assert page[2] == sorted((i for i in live if i % 2 == 0), key=lambda i: (-(i % 7), i))[2:5]
    assert page[3] == sorted(live, reverse=True)[:4] and 9 not in page and len(page[1]) == got[1]


def words_and_names(seed):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choice("abK") for _ in range(rng.randrange(1, 16)))
    some = [make() for _ in range(40)]
    near = []
    for n in some:
        w = list(n)
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "a", "b"])
        near.append("".join(w))
    return [w for w in near + [make() for _ in range(40)] if w], [(n, rng.randrange(3, 9)) for n in dict.fromkeys(some)] + [("Two Words", 9), ("", 4)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_names_miss_none(spark, seed):
    words, known = words_and_names(seed)
    got = {r.w: r.name for r in names.nearest_names(spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame(known, "surface string, freq long")).collect()}
    single = [(n, f) for n, f in known if n and " " not in n]
    want = {}
    for w in set(words) - {n for n, _ in single}:
        near = [(distance(w, n) / max(len(w), len(n)), -f, n) for n, f in single]
        near = [x for x in near if x[0] <= 0.3 + 1e-9]
        if near:
            want[w] = min(near)[2]
    assert got == want and len(want) > 10


def test_correction_leaves_the_rest(spark):
    rows = spark.createDataFrame([(1, "Caladin met kaladin; (Kaladln) Kaladin's Adolin\n"), (2, None), (3, "none")], "k long, t string")
    known = spark.createDataFrame([("Kaladin", 5), ("Dalinar", 4)], "surface string, freq long")
    got = {r.k: r.t for r in names.corrected(rows, "k", "t", known).collect()}
    assert got == {1: "Kaladin met kaladin; (Kaladin) Kaladin's Adolin\n".replace("Kaladin's", got[1].split(") ")[1].split(" ")[0]), 2: None, 3: "none"}
    assert got[1].startswith("Kaladin met kaladin; (Kaladin) ")


def runs(text):
    out, run, first, run_first = [], [], True, False
    for m in re.finditer(r"[^\W\d_][\w'’]*|[.!?\n]", text or ""):
        w = m.group()
        if w in ".!?\n" or not w[0].isupper():
            if run and not (len(run) == 1 and run_first):
                out.append(" ".join(run))
            run, first = [], w in ".!?\n"
            continue
        if not run:
            run_first = first
        run.append(w)
        first = False
    return out + ([" ".join(run)] if run and not (len(run) == 1 and run_first) else [])


def test_capitalised_runs_are_the_state_machine(spark):
    rng = random.Random(7)
    pieces = ["The", "the", "Éa", "ñ", "O'Neil", "X", "3Rd", "_Ab", "ÉCOLE", "straße", ".", "!", "?", "\n", ",", " ", " ", " ", "-", "'", "漢字", "5", "’s"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None, "WORD " * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.n for r in rows.select("i", names.capitalised_runs(F.col("t")).alias("n")).collect()}
    assert got == {i: runs(t) for i, t in enumerate(texts)}


def test_names_said_by_brute_force(spark):
    rng = random.Random(3)
    segments = [(b, i, i * 10_000, i * 10_000 + rng.choice([0, 10_000]), " ".join(rng.choice(["Ann", "anna", "read by", "XY", "of", "The House"]) for _ in range(rng.randrange(4))) or None) for b in range(25) for i in range(12)]
    known = [("publisher", 1, "the house"), ("author", 2, "Anna"), ("author", 2, "Ann"), ("narrator", 3, "of"), ("narrator", 3, "y"), ("phrase", 0, "by XY"), ("phrase", 0, "")]
    got = {(r.book_id, r.place): (r.kind, r.name, r.start_ms, r.end_ms) for r in names.stated_names(
        spark.createDataFrame(segments, "book_id long, idx long, start_ms long, end_ms long, text string"), spark.createDataFrame(known, "kind string, rank int, name string")).collect()}
    want = {}
    for b, place in itertools.product(range(25), ("head", "tail")):
        own = [s for s in segments if s[0] == b]
        total = max(s[3] for s in own)
        own = [s for s in own if (s[2] < 60_000 if place == "head" else s[3] > total - 30_000)]
        whole, at = "", []
        for s in own:
            whole += " " if at else ""
            at.append(len(whole))
            whole += (s[4] or "").lower()
        hits = [(rank, whole.find(n.lower()), n, kind) for kind, rank, n in known if n and n.lower() in whole]
        if hits:
            _, p, n, kind = min(hits)
            start = max(s[2] for s, a in zip(own, at) if a <= p)
            end = [s[3] for s, a in zip(own, at) if a <= p + len(n)][-1]
            want[b, place] = (kind, n, start, end if end > start else start + 1000)
    assert got == want and len(want) > 30


def one_by_one(old, new):
    taken, out, seen = set(old), {}, set()
    for place, p, c in sorted(new):
        if p is None or c is None or p == c or (p, c) in seen or (p, c) in old:
            continue
        seen.add((p, c))
        at, open_ = set(), [c]
        while open_:
            x = open_.pop()
            if x not in at:
                at.add(x)
                open_ += [b for a, b in taken if a == x]
        out[place, p, c] = p not in at
        if p not in at:
            taken.add((p, c))
    return out


@pytest.mark.parametrize("batch", [9, 512])
def test_hierarchies_take_edges_in_order(spark, batch):
    rng = random.Random(batch)
    tags = [f"t{i}" for i in range(14)]
    new = [(i // 2, rng.choice(tags), rng.choice(tags)) for i in range(30)] + [(900, None, "t1"), (901, "x", "y"), (902, "y", "z"), (903, "z", "x"), (904, "z", "x")]
    old = {("t0", "t1"), ("t1", "t2"), ("t5", "t0")}
    got = hierarchy.accepted(spark.createDataFrame(sorted(old), "parent string, child string"), spark.createDataFrame(new, "place long, parent string, child string"), batch)
    assert {(r.place, r.parent, r.child): r.taken for r in got.collect()} == one_by_one(old, new)


STATE = "target_kind string, target_id bigint, field string, value string"
OPS = "op_id bigint, batch_id string, target_kind string, target_id bigint, field string, before string, after string, progress string"


def test_replay_half_applied_twice_is_once(spark, store):
    ops = [
        (1, "x", "book", 1, "title", "a", "b", "pending"), (2, "x", "book", 1, "title", "b", "c", "pending"), (3, "x", "book", 2, "title", None, "n", "pending"),
        (4, "y", "book", 3, "title", "old", "new", "pending"), (5, "y", "book", 4, "title", "is", "was", "pending"),
        (6, None, "book", 5, "title", "s", None, "pending"), (7, "z", "book", 6, "title", "q", "r", "done"), (8, "w", "book", 3, "title", "new", "newer", "pending"),
    ]
    # x broke off after its first operation, y after its first; y's second meets a value that someone else has set.
    state = [("book", 1, "title", "b"), ("book", 3, "title", "new"), ("book", 4, "title", "mine"), ("book", 5, "title", "s"), ("book", 6, "title", "q")]
    store.write(state=spark.createDataFrame(state, STATE), journal=spark.createDataFrame(ops, OPS))
    assert journal.recover(store) == 2
    once = sorted(tuple(r) for r in store.read("state").select("target_id", "value").collect())
    marks = {r.op_id: r.progress for r in store.read("journal").collect()}
    # w follows y on book 3: what is there is what w begins from, so it goes on; y is taken back elsewhere.
    assert once == [(1, "c"), (2, "n"), (3, "newer"), (4, "mine"), (6, "q")]
    assert marks == {1: "done", 2: "done", 3: "done", 4: "failed", 5: "failed", 6: "done", 7: "done", 8: "done"}
    assert journal.recover(store) == 2
    # The same again from the half-applied state and from the whole one: nothing else comes of it.
    again, _ = journal.replayed(store.read("state"), spark.createDataFrame([(*o[:7], "pending") if marks[o[0]] == "done" and o[0] not in (7, 8) else o for o in ops if o[0] not in (4, 5, 8)], OPS))
    assert sorted(tuple(r) for r in again.select("target_id", "value").collect()) == once


def test_failed_batches_are_taken_back(spark):
    ops = [(1, "y", "book", 3, "title", "old", "new", "pending"), (2, "y", "book", 4, "title", "is", "was", "pending")]
    state = spark.createDataFrame([("book", 3, "title", "new"), ("book", 4, "title", "mine")], STATE)
    got, log = journal.replayed(state, spark.createDataFrame(ops, OPS))
    assert sorted((r.target_id, r.value) for r in got.collect()) == [(3, "old"), (4, "mine")] and {r.progress for r in log.collect()} == {"failed"}


def test_appending_a_batch_again_changes_nothing(spark, store):
    schema = "batch_id string, target_kind string, target_id bigint, field string, before string, after string, actor string, edit_id bigint"
    edits = spark.createDataFrame([("a", "f", 1, "t", "x", 'y"\n', "me", 1), ("a", "f", 1, "t", 'y"\n', "z", "me", 2), ("a", "f", 2, "t", None, None, "me", 3), ("b", "f", 1, "t", None, "é", "me", 4)], schema)
    assert journal.append(store, edits.where("batch_id = 'a'")) == 1
    journal.append(store, edits)
    journal.append(store, edits.where("edit_id = 2"))
    assert sorted((r.batch_id, r.before_value, r.after_value) for r in store.read("history").collect()) == [("a", '"x"', '"z"'), ("b", None, '"é"')]


def test_cleanup_reports_what_it_takes_and_fails_whole(spark, store, monkeypatch):
    now, day = datetime.datetime(2024, 6, 1), datetime.timedelta(days=1)
    rows = {
        "journal": spark.createDataFrame([(1, "done", now - 100 * day), (2, "pending", now - 100 * day), (3, "failed", now - 30 * day)], "op_id long, progress string, created_at timestamp_ntz"),
        "nearby": spark.createDataFrame([(1, now - 91 * day), (2, now - 89 * day)], "id long, discovered_at timestamp_ntz"),
        "files": spark.createDataFrame([(1, 1, "mp3", True), (2, 1, "m4b", True), (3, 2, "mp3", True), (4, 3, "mp3", True), (5, 3, "m4b", True), (6, 1, "flac", False)], "file_id long, book_id long, format string, is_active boolean"),
        "refs": spark.createDataFrame([(4, None), (1, now)], "file_id long, released_at timestamp_ntz"),
    }
    keys, names_ = {"journal": "op_id", "nearby": "id", "files": "file_id"}, tuple(rows)
    store.write(**rows)
    at = F.lit(now)
    tables = {n: store.read(n) for n in names_}
    assert {r.name: (r.enabled, r.rows) for r in cleanup.report(tables, cleanup.TARGETS, at).collect()} == {"journal": (True, 1), "nearby_books": (True, 1), "transcoded_sources": (True, 1)}
    assert {r.name: r.rows for r in cleanup.report(tables, cleanup.TARGETS, at, {"records"}, force=True).collect()} == {"journal": 2, "nearby_books": 0, "transcoded_sources": 0}
    with monkeypatch.context() as broken:
        broken.setattr(Versioned, "commit", lambda *a: (_ for _ in ()).throw(OSError("no commit")))
        with pytest.raises(OSError):
            cleanup.applied(store, names_, cleanup.TARGETS, keys, at)
    assert store.number() == 1
    cleanup.applied(store, names_, cleanup.TARGETS, keys, at)
    kept = {n: sorted(r[0] for r in store.read(n).select(keys[n]).collect()) for n in keys}
    assert kept == {"journal": [2, 3], "nearby": [2], "files": [2, 3, 4, 5, 6]}
    assert all(r.rows == 0 for r in cleanup.report({n: store.read(n) for n in names_}, cleanup.TARGETS, at).collect())


def test_promotion_is_one_commit(spark, store, monkeypatch):
    m = "row_id long, book_id long, file_id long, kind string, method string, confidence double, status string, start_ms long, end_ms long, padding_ms long"
    matches = [(1, 1, 1, "intro", "fingerprint_full", 0.9, "candidate", 0, 5000, 500), (2, 1, 1, "outro", "fingerprint_bookend", 0.8, "candidate", 50_000, 60_000, None), (3, 1, 2, "intro", "manual", 1.0, "candidate", 0, 9, None), (4, 2, 3, "intro", "fingerprint_full", 0.5, "candidate", 0, 5000, None)]
    chapters = [(1, 0, 0, 20_000), (1, 1, 20_000, 60_000), (3, 0, 0, 5000)]
    store.write(matches=spark.createDataFrame(matches, m), chapters=spark.createDataFrame(chapters, "file_id long, idx long, start_ms long, end_ms long"), books=spark.createDataFrame([(1, 100_000, "candidate"), (2, 5, "none")], "book_id long, duration_ms long, audiologo_status string"))
    with monkeypatch.context() as broken:
        broken.setattr(Versioned, "commit", lambda *a: (_ for _ in ()).throw(OSError("no commit")))
        with pytest.raises(OSError):
            cleanup.promote(store)
    assert store.number() == 1
    assert cleanup.promote(store) == 2 == cleanup.promote(store)
    assert {r.row_id: r.status for r in store.read("matches").collect()} == {1: "applied", 2: "applied", 3: "candidate", 4: "candidate"}
    assert sorted((r.file_id, r.idx, r.start_ms, r.end_ms) for r in store.read("chapters").collect()) == [(1, 0, 0, 15_500), (1, 1, 15_500, 45_500), (3, 0, 0, 5000)]
    assert {r.book_id: (r.duration_ms, r.audiologo_status) for r in store.read("books").collect()} == {1: (85_500, "applied"), 2: (5, "none")}


def test_tasks(spark):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    runs = [("a", at(0), 1, True, "s"), *[("a", at(i), i + 1, False, f"e{i}") for i in range(1, 6)], ("b", at(3), 1, False, "x"), ("b", at(3), 2, True, "y")]
    got = {r.task: tuple(r)[1:] for r in tasks.states(spark.createDataFrame(runs, "task string, at timestamp_ntz, run_id long, ok boolean, summary string"), spark.createDataFrame([("a", 600), ("b", 60), ("c", 60)], "task string, interval_s long")).collect()}
    assert got == {"a": (at(5), "error", "e5", 5, at(5 + 80)), "b": (at(3), "ok", "y", 0, at(4)), "c": (None, None, None, 0, None)}


def test_seed_files_set_broken_ones_aside(spark, tmp_path):
    good = '[{"publisher":"P","intro_fingerprint_b64":"AA","intro_fingerprint_duration_ms":5,"intro_transcript":"t"},{"outro_fingerprint_b64":"BB","intro_fingerprint_b64":"","extra":1},{"publisher":7,"outro_fingerprint_duration_ms":"x"}]'
    (tmp_path / "good.json").write_text(good)
    (tmp_path / "cut.json").write_text(good[:90])
    (tmp_path / "none.json").write_text("")
    found, broken = seeds.seed_files(spark, *(f"{tmp_path}/{n}.json" for n in ("good", "cut", "none")))
    got = sorted((os.path.basename(r.path), r.publisher or "", r.position, r.fingerprint_b64, r.duration_ms, r.confirmed) for r in found.collect())
    assert got == [("good.json", "", "outro", "BB", 0, False), ("good.json", "P", "intro", "AA", 5, False)]
    assert sorted(os.path.basename(r.path) for r in broken.collect()) == ["cut.json", "good.json"] or sorted(os.path.basename(r.path) for r in broken.collect()) == ["cut.json", "good.json", "none.json"]
    with pytest.raises(ValueError):
        seeds.seed_files(spark, f"{tmp_path}/a.csv")


def test_a_sparse_file_of_3_gb_has_a_key(spark, tmp_path):
    for name, head in (("a.m4b", b"x" * 5000), ("b.m4b", b"x" * 4096 + b"y"), ("c.m4b", b"z")):
        with open(tmp_path / name, "wb") as f:
            f.write(head)
            f.truncate(3 << 30)
        os.utime(tmp_path / name, (1_700_000_000, 1_700_000_000))
    rows = formats.audio_files(spark, str(tmp_path)).unionByName(spark.createDataFrame([(f"file:{tmp_path}/gone.m4b", 1, datetime.datetime(2024, 1, 1), "", "gone.m4b", "m4b")], "path string, size long, modified timestamp, parent string, name string, extension string"))
    key = {r.name: r.content_key for r in formats.content_key(rows).collect()}
    assert key["a.m4b"] == key["b.m4b"] != key["c.m4b"] and len(key["a.m4b"]) == 64 and key["gone.m4b"] is None
