"""Phrase collocation mining: phrases of 2 to 5 words that a language's texts hold often, by their weakest cut.

Words are lower-cased (A-Z) runs without blanks inside pieces of a text between punctuation and line ends. Level by
level: texts are sequences of slots, one for each frequent phrase of k words, and two slots side by side are a phrase of
k + 1 words. Such a pair is a candidate only if both its phrases are frequent (Apriori), so are the sums of all that fall into its
two bins of a fixed-size array of hashed counts made one pass before, and so is the sum of what all tasks met of it: bins fill as
the input grows and then leave out nothing, while the sums keep candidates to one for each `least` words. Candidates get a minimal
perfect hash with their keys stored (perfect_hash); mappers look up the pairs, check the stored key, add ones into numpy arrays by
slot, and a tree sums the arrays. What reaches `least` is frequent. A cut's two sides are phrases of lower levels, read by slot.

A pair of slots names a phrase exactly, so nothing hangs on a hash: words are checked against the stored words, pairs
against the stored pairs, and bins only leave out what can't be frequent. A sequence gets shorter at each level, as
slots without a frequent neighbour go. Sums are exact: scores are computed in decimals of 38 digits.

A phrase is dropped where a longer candidate that holds it is as frequent. Then one with one word more is so as well,
hence only the next level's pairs are looked at.

Defined cases: a null text is empty, a null lang is `und` (as is one of that name); repeated rows count each time; doc_id
is not looked at; words and phrases are told apart by their bytes; ties in score and count go by the phrase's bytes; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import arrow_text as A
from lectern.llm import perfect_hash as H
from lectern.llm.shared import discard, written

#: Bins of hashed pairs: 2 ** BINS counts, of which one bit each goes to the tasks; a pair has one in each half.
BINS = 22
#: Buckets of candidates at least, and words for each one more: a group of a bucket holds a bounded part of all pairs.
BUCKETS, WORDS = 64, 1 << 21
#: Bytes of text, and slots, looked at together; pairs that a task holds before it hands them on.
TEXT, SLOTS, HELD = 4 << 20, 1 << 20, 2 << 20
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
FREQUENT = "kind string, id bigint, part int, width int, data binary"


class Words:
    """The words of a slice of rows: distinct (lang, word) pairs, which one each word is, where pieces begin."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = A.text_buffers(A.column(batch, "text"))
        data = A.LOWER[data]
        cut = BREAK[data]
        inside = ~(cut | BLANK[data])
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]]))) if len(data) else np.zeros(0, np.int64)
        place = np.cumsum(inside)
        ends = np.concatenate([place[begin] - 1, place[-1:] if len(data) else [0]])
        row = np.searchsorted(offsets, begin, "right") - 1
        cuts = np.cumsum(cut)[begin] if len(begin) else begin
        self.opens = np.concatenate([[True], (row[1:] != row[:-1]) | (cuts[1:] != cuts[:-1])]) if len(begin) else np.zeros(0, bool)
        words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inside])])
        words = words.dictionary_encode()
        langs = A.column(batch, "lang").dictionary_encode()
        self.langs, self.words = langs.dictionary, words.dictionary
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        flat = lang * max(1, len(self.words)) + words.indices.to_numpy(zero_copy_only=False)
        self.pairs, self.which, self.counts = np.unique(flat, return_inverse=True, return_counts=True)
        self.totals = np.bincount(lang, minlength=len(self.langs))
        self.lang, self.word = np.divmod(self.pairs, max(1, len(self.words)))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each distinct pair."""
        return keys(self.words, self.langs, self.word, self.lang)


def keys(words: pa.Array, langs: pa.Array, word: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for multiplier in (A.MULTIPLIER, 0xD1342543DE82EF95):
        w, g = (hashes(x, multiplier)[i] for x, i in ((words, word), (langs, lang)))
        with np.errstate(over="ignore"):
            out.append((A.mix(w ^ (g * np.uint64(multiplier)))).view(np.int64))
    return out[0], out[1]


def hashes(array: pa.Array, multiplier: int) -> np.ndarray:
    """A hash of each text."""
    data, offsets = A.text_buffers(array)
    sizes = np.diff(offsets)
    within = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, multiplier, np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(A.BYTE_VALUE[data] * power[within])])
        return A.mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes.astype(np.uint64))


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, a); a null word stands for all of a lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text", TEXT):
            w = Words(batch)
            langs = pa.concat_arrays([w.langs.take(pa.array(w.lang)), w.langs])
            words = pa.concat_arrays([w.words.take(pa.array(w.word)), pa.nulls(len(w.langs), pa.large_string())])
            yield pa.RecordBatch.from_arrays([langs.cast(pa.string()), words.cast(pa.string()), pa.array(np.concatenate([w.counts, w.totals]).astype(np.int64))], ["lang", "word", "a"])

    return rows.mapInArrow(run, "lang string, word string, a bigint").groupBy("lang", "word").agg(F.sum("a").alias("a"))


def keyed(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                every = np.arange(b.num_rows)
                p, q = keys(A.column(b, "word"), A.column(b, "lang"), every, every)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), A.column(b, "lang"), A.column(b, "word")], ["p", "q", "lang", "word"])

    return words.mapInArrow(run, "p bigint, q bigint, lang string, word string")


def pairs_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of two slots side by side, the slots, their hash)"""
    at = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
    p, q = s[at], s[at + 1]
    return at, p, q, H.pair_hash(p, q)


def bins_of(h: np.ndarray) -> Iterator[np.ndarray]:
    """The two bins of each hash, one in each half of the array."""
    half = BINS - 1
    yield (h >> np.uint64(64 - half)).astype(np.int64)
    yield (h & np.uint64((1 << half) - 1)).astype(np.int64) + (1 << half)


def passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for b in bins_of(h):
        out &= (bits[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)
    return out


def shortened(s: np.ndarray) -> np.ndarray:
    """s without slots that have no slot beside them, and with one -1 between runs."""
    alive = s >= 0
    pair = alive & (np.concatenate([[False], alive[:-1]]) | np.concatenate([alive[1:], [False]]))
    keep = pair | np.concatenate([[False], pair[:-1]])
    return np.where(pair, s, -1)[keep]


class Pass:
    """What a task hands on from one pass: sequences at once, bins of pairs side by side and counts at its end."""

    def __init__(self, bins: bool):
        self.bins = np.zeros(1 << BINS, np.uint32) if bins else None
        self.tally = H.Tally()
        context = TaskContext.get()
        self.part = context.partitionId() if context else 0

    def row(self, kind: str, i: int, x: np.ndarray) -> pa.RecordBatch:
        width, data = H.narrow(x) if kind == "sequence" else H.packed(x)
        return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([i], pa.int64()), pa.array([self.part], pa.int32()), pa.array([width], pa.int32()), pa.array([data], pa.binary())], ["kind", "id", "part", "width", "data"])

    def sequence(self, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        s = shortened(s)
        if self.bins is not None:
            for b in bins_of(pairs_of(s)[3]):
                np.add.at(self.bins, b, 1)
        if len(s):
            yield self.row("sequence", 0, s)

    def counts(self) -> Iterator[pa.RecordBatch]:
        for i, x in self.tally.taken():
            yield self.row("count", i, x)

    def last(self) -> Iterator[pa.RecordBatch]:
        yield from self.counts()
        if self.bins is not None:
            for i, x in enumerate(self.bins.reshape(-1, H.BLOCK)):
                if x.any():
                    yield self.row("bin", i, x)


def first_pass(rows: DataFrame, uri: str, shards: int) -> DataFrame:
    """Sequences of frequent words, and bins of their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, reader = Pass(True), H.Reader(uri, shards, ("lang", "word"))
        for batch in A.slices(batches, "text", TEXT):
            w = Words(batch)
            p, q = w.keys()
            h = H.pair_hash(p, q)
            shard, slot = H.shard_of(h, shards), np.full(len(p), -1, np.int64)
            for group, own in reader.groups(shard):
                found, stored = group.find(p[own], q[own], h[own], shard[own])
                met = np.flatnonzero(found >= 0)
                at, mine = pa.array(stored[met]), own[met]
                same = pc.and_(
                    pc.equal(group.extra["word"].take(at).cast(pa.large_string()), w.words.take(pa.array(w.word[mine]))),
                    pc.equal(group.extra["lang"].take(at).cast(pa.large_string()), w.langs.take(pa.array(w.lang[mine])).cast(pa.large_string())),
                ).to_numpy(zero_copy_only=False)
                slot[mine[same]] = found[met[same]]
            s = np.full(len(w.which) + int(w.opens.sum()), -1, np.int64)
            if len(s):
                s[np.arange(len(w.which)) + np.cumsum(w.opens)] = slot[w.which]
                yield from out.sequence(s)
        yield from out.last()

    return rows.mapInArrow(run, FREQUENT)


def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The sequences of a task, some joined, with -1 between them."""
    held, size = [], 0
    for b in batches:
        for width, data in zip(A.column(b, "width").to_pylist(), A.column(b, "data").to_pylist(), strict=True):
            held += [H.wide(width, data), np.array([-1])]
            size += len(held[-2])
            if size >= SLOTS:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def summed(p: np.ndarray, q: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (p, q) of slots in order, and the sum of each one's n."""
    if len(p) and max(int(p.max()), int(q.max())) < 1 << 31:
        order = np.argsort(p << 32 | q)
    else:
        order = np.lexsort((q, p))
    p, q, n = p[order], q[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])) if len(p) else np.zeros(0, np.int64)
    return p[first], q[first], np.add.reduceat(n, first) if len(p) else n


PAIRS = "id int, part int, widths array<int>, p binary, q binary, n binary"


def candidates(sequence: DataFrame, bits: np.ndarray, least: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(distinct pairs (p, q) of slots side by side, in bins that hold enough, that come `least` times; the written table that they
    are read from). A task hands its pairs and their counts on as arrays, one for each of the buckets of hashes; these are added
    up a tree, and are a row each only then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        none = (np.zeros(0, np.int64),) * 3
        held = none
        for s in sequences(batches):
            _, p, q, h = pairs_of(s)
            good = passing(bits, h)
            held = tuple(np.concatenate(x) for x in zip(held, summed(p[good], q[good], np.ones(int(good.sum()), np.int64)), strict=True))
            if len(held[0]) > HELD:
                held = summed(*held)
                if len(held[0]) > HELD // 2:
                    yield from dealt(*held, part)
                    held = none
        yield from dealt(*summed(*held), part)

    def row(i: int, part: int, *arrays: np.ndarray) -> pa.RecordBatch:
        widths, data = zip(*map(H.narrow, arrays), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([widths], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in data)], ["id", "part", "widths", *"pqn"])

    def dealt(p: np.ndarray, q: np.ndarray, n: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
        bucket = (H.pair_hash(p, q) >> np.uint64(24)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[b] : bounds[b + 1]]
            yield row(b, part, p[own], q[own], n[own])

    def read(rows: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
        widths = rows.column("widths").to_pylist()
        return [np.concatenate([H.wide(w[i], x) for w, x in zip(widths, rows.column(c).to_pylist(), strict=True)]) for i, c in enumerate("pqn")]

    def unite(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([row(group.column("id")[0].as_py(), group.column("part")[0].as_py(), *summed(*read(group)))])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                p, q, n = read(b.slice(i, 1))
                yield pa.RecordBatch.from_arrays([pa.array(p[n >= least]), pa.array(q[n >= least])], ["p", "q"])

    arrays = written(sequence.mapInArrow(run, PAIRS), "pairs")
    most = arrays.agg(F.max("part")).first()[0] or 0
    united = arrays
    while True:
        united = united.withColumn("part", F.floor(F.col("part") / H.ARITY).cast("int")).groupBy("id", "part").applyInArrow(unite, PAIRS)
        most //= H.ARITY
        if not most:
            return united.mapInArrow(unpack, "p bigint, q bigint"), arrays


def next_pass(sequence: DataFrame, bits: np.ndarray, uri: str, shards: int, more: bool) -> DataFrame:
    """Counts of the candidates by slot, and (more) sequences of them and bins of their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, reader = Pass(more), H.Reader(uri, shards)
        for s in sequences(batches):
            at, p, q, h = pairs_of(s)
            good = passing(bits, h)
            slot = reader.slots(p[good], q[good], h[good])
            out.tally.add(slot[slot >= 0])
            if more:
                new = np.full(len(s), -1, np.int64)
                new[at[good]] = slot
                yield from out.sequence(new)
            if out.tally.full():
                yield from out.counts()
        yield from out.last()

    return sequence.mapInArrow(run, FREQUENT)


def bin_bits(bins: DataFrame, least: int) -> np.ndarray:
    """One bit for each bin, set where the sum is at least `least`: 2 ** BINS bits, whatever the input."""
    out = np.zeros(1 << (BINS - 3), np.uint8)
    for i, width, data in H.tree_sum(bins).select("id", "width", "data").toLocalIterator():
        out[i * H.BLOCK // 8 : (i + 1) * H.BLOCK // 8] = np.packbits(H.unpacked(width, bytes(data)) >= least, bitorder="little")
    return out


def of_kind(made: DataFrame, kind: str) -> DataFrame:
    return made.where(F.col("kind") == kind)


def frequent(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[list[DataFrame], DataFrame]:
    """(levels, totals): for each length from 1 on the frequent phrases (slot, p, q, lang, phrase, last, a, lefts,
    rights), and (lang, n). lefts and rights: the counts of both sides of each cut."""
    rows = rows_of(docs)
    counts = written(word_counts(rows).where(F.col("word").isNull() | (F.col("a") >= least)), "words")
    totals = counts.where("word is null").select("lang", F.col("a").alias("n"))
    buckets = max(BUCKETS, (totals.agg(F.sum("n")).first()[0] or 0) // WORDS)
    words = counts.where("word is not null")
    shards, n = H.build(keyed(words), ("lang", "word"))
    none = F.array().cast("array<bigint>")
    slots = H.keys_by_slot(shards, ("lang", "word")).join(words, ["lang", "word"])
    levels = [written(slots.select("slot", F.lit(None).cast("bigint").alias("p"), F.lit(None).cast("bigint").alias("q"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("lefts"), none.alias("rights")), "level")]
    made = written(first_pass(rows, shards.written_to, n), "pass")
    discard(shards)
    for k in range(2, longest + 1):
        sequence, before = of_kind(made, "sequence"), levels[-1]
        bits = bin_bits(of_kind(made, "bin"), least)
        if not bits.any():
            break
        found, arrays = candidates(sequence, bits, least, buckets)
        found = written(found, "candidates")
        discard(arrays)
        shards, n = H.build(found)
        after = written(next_pass(sequence, bits, shards.written_to, n, k < longest), "pass")
        a = H.each_count(H.tree_sum(of_kind(after, "count")), least)
        keys_ = H.keys_by_slot(shards).join(a, "slot")
        left = before.select(F.col("slot").alias("p"), "lang", F.col("phrase").alias("head"), F.col("a").alias("pa"), F.col("lefts").alias("pl"))
        right = before.select(F.col("slot").alias("q"), "last", F.col("a").alias("qa"), F.col("rights").alias("qr"))
        level = keys_.join(left, "p").join(right, "q").select(
            "slot", "p", "q", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a",
            F.concat("pl", F.array("pa")).alias("lefts"), F.concat(F.array("qa"), "qr").alias("rights"),
        )
        levels.append(written(level, "level"))
        discard(found, shards, made)
        made = after
    discard(made)
    return levels, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's best phrases of docs (lang, text)."""
    levels, totals = frequent(docs, least, longest)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    kept = []
    for k, level in enumerate(levels[1:], 2):
        if k < len(levels):
            within = levels[k].select(F.explode(F.array("p", "q")).alias("slot"), F.col("a").alias("most")).groupBy("slot").agg(F.max("most").alias("most"))
            level = level.join(within, "slot", "left").where("most is null or most < a")
        kept.append(level.select("lang", "phrase", "a", "lefts", "rights"))
    if not kept:
        return levels[0].limit(0).select("lang", F.lit(0).alias("rank"), "phrase", "a", F.lit(0).cast("bigint").alias("l"), F.lit(0).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("score"))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    rows = rows.join(totals, "lang").withColumn("up", F.lit(1000).cast("decimal(38,0)") * big("a") * big("n"))
    cut = F.expr("array_min(transform(arrays_zip(lefts, rights), (s, i) -> struct(up div (cast(s.lefts as decimal(38,0)) * cast(s.rights as decimal(38,0))) as score, i as cut, s.lefts as l, s.rights as r)))")
    rows = rows.withColumn("best", cut).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").cast("bigint").alias("score"))
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # A lang may hold most phrases: first the best of 64 parts of it, then the best of those.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("nth") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("int")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
