"""Benchmark decontamination by canonical templates.

Texts are reduced to templates: numbers, names and units become typed placeholders, other words are
lower-cased without punctuation at their ends. Windows of n template tokens are hash-joined with the
benchmark's. In a pair of document and item, windows that match on one diagonal (the document's place
less the item's) are chained. A chain's slots, the values behind the placeholders, are checked: for each
value of the item the document's value in most places stays, and windows with another one are dropped;
different values of the item may share one of the document. A number that the document keeps in one
place and changes in another throws the whole chain away (an asserted case of the tests; near-verbatim copies
with one of two equal numbers changed are lost by it). Chains that together cover enough of the item's
windows are a leak (several chains: words were put in or left out).

A name is a capitalised word inside a sentence; the first word of one may be a name or not. A number is a run of
digits with inner punctuation and perhaps a unit's letters behind it; a unit is, after a number, a word of at most three
letters (of one over another, too) or a spelt-out one of UNITS. What counts as a name hangs on case and on the
word before, so each window is posted under up to three hashes that differ: of its plain case-folded words, of its
template, and (whole windows) of its template with sentences' first words as names; any of them brings a pair, so copies in
another case, after a heading or with other names at sentence starts are found. The last two need two plain words at least: a run of
numbers or names says nothing by its kinds, so it matches by its own words only and has no slots.

Texts are parsed by columns: split by Arrow, each distinct word looked at once a task, the rest in numpy.

A window without slots that an item repeats is covered wherever the document has it, and takes no part in chains: a
document's repeats of it are one row. Others are a row for each place in the document and each in the item that
has the same window. Conflicts are counted by groups of (document, item, diagonal, value), so no row holds a chain.

Before the join a fixed-size bit map of the benchmark's windows (2**22 bits; it only saves work, as the
join decides) drops document windows that no item has, so of the documents only near-hits are
shuffled. Very common windows meet few rows of the benchmark per key, and pairs are aggregated by
(document, item, diagonal).

Defined cases: null and empty texts and items have no windows and no leaks; items with fewer than n
tokens are one window of their own length, and match where that run of tokens stands in a document;
repeated documents are reported once per doc_id; ties need no order; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import arrow_text as A
from lectern.llm.shared import written

BITS = 22
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(%|[^\W\d_]{1,3}[²³]?)?")
UNIT = re.compile(r"[^\W\d_]{1,3}[²³]?(/[^\W\d_]{1,4}[²³]?)?")
#: Spelt-out words that are units after a number, beside those that UNIT matches.
UNITS = frozenset("hours days weeks years dollars euros cents percent".split())
#: Letters that UNIT or UNITS take at most.
LONGEST_UNIT = 10
EDGE = " \t\n\r.,;:!?\"'()[]{}<>*#$%&|_-–—…«»„“”"


#: What the kinds of slots put into a template; 0 is no slot.
PLACEHOLDERS = (None, "\x01n", "\x01u", "\x01c")
KNOWN = 400_000
#: Plain words that a window has at least if its slots may hold other values.
PLAIN = 2


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))


IDS = np.array([0, *(_hash(t) for t in PLACEHOLDERS[1:])], np.uint64)


def _word(raw: str) -> tuple[str, int, bool, bool, bool, bool]:
    """(word case-folded, its hash, is a number, may be a unit, may be a name, ends a sentence) of a run without blanks."""
    word = raw.strip(EDGE)
    low = word.casefold()
    ends = raw[-1:] in (".", "!", "?") or raw[-2:-1] in (".", "!", "?")
    first = word[:1]
    number = (first.isdigit() or first in "+-") and bool(NUMBER.fullmatch(word))
    unit = len(low) <= LONGEST_UNIT and (low in UNITS or bool(UNIT.fullmatch(low)))
    return low, _hash(low), number, unit, first.isupper() and not word.isupper(), ends


@dataclass
class Parsed:
    """The words of a batch of texts: flat arrays, and where each text's words start and how many they are."""

    vocabulary: pa.Array
    word: np.ndarray
    ids: np.ndarray
    kinds: np.ndarray
    first_names: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def parsed(texts: pa.Array, known: dict[str, tuple]) -> Parsed:
    """kinds: of the words' slots, with sentences' first words as plain words; first_names: where these may be names."""
    lists = pc.utf8_split_whitespace(texts.fill_null(""))
    coded = lists.flatten().dictionary_encode()
    found = []
    for raw in coded.dictionary.to_pylist():
        w = known.get(raw)
        if w is None:
            if len(known) > KNOWN:
                known.clear()
            w = known[raw] = _word(raw)
        found.append(w)
    low, ids, *flags = zip(*found, strict=True) if found else ((), (), (), (), (), ())
    real = np.array([bool(x) for x in low], bool)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    keep = real[code] if len(code) else np.zeros(0, bool)
    code, text = code[keep], text[keep]
    digits, unit, name, ends = (np.array(f, bool)[code] for f in flags) if len(code) else (np.zeros(0, bool),) * 4
    first = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
    after_number = np.concatenate([[False], digits[:-1]]) & ~first if len(text) else first
    start = np.concatenate([[True], ends[:-1]]) | first if len(text) else first
    kinds = np.where(digits, 1, np.where(after_number & unit, 2, np.where(name & ~start, 3, 0))).astype(np.int8)
    sizes = np.bincount(text, minlength=len(texts)).astype(np.int64)
    return Parsed(pa.array(low, pa.string()), code, np.array(ids, np.uint64)[code] if len(code) else np.zeros(0, np.uint64), kinds, name & start & (kinds == 0), np.cumsum(sizes) - sizes, sizes)


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` tokens, in order."""
    with np.errstate(over="ignore"):
        out = np.full(max(0, len(ids) - size + 1), size, np.uint64)
        factor = 1
        for k in range(size):
            factor = factor * A.MULTIPLIER & A.M64
            out += ids[k : len(ids) - size + 1 + k] * np.uint64(factor)
    return A.mix(out)


def forms(p: Parsed, size: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes of all runs of `size` words, whether each is posted, the words' kinds) in each form of a window."""
    plain = window_hashes(p.ids, size)
    yield plain, np.ones(len(plain), bool), p.kinds
    template = window_hashes(np.where(p.kinds > 0, IDS[p.kinds], p.ids), size)
    words = np.concatenate([[0], np.cumsum(p.kinds == 0)])
    yield template, (template != plain) & (words[size:] - words[:-size] >= PLAIN), p.kinds
    if size == n and p.first_names.any():
        kinds = np.where(p.first_names, 3, p.kinds).astype(np.int8)
        third = window_hashes(np.where(kinds > 0, IDS[kinds], p.ids), size)
        total = np.concatenate([[0], np.cumsum(kinds == 0)])
        yield third, (third != template) & (third != plain) & (total[size:] - total[:-size] >= PLAIN), kinds


WINDOWS = "id bigint, pos int, h bigint, n_windows int, words array<string>, kinds array<int>"


def windows(rows: DataFrame, n: int, sizes: list[int] | None = None, bitmap: np.ndarray | None = None) -> DataFrame:
    """Rows (id, pos, h, n_windows, words, kinds) of the windows of rows (id, text): of n tokens, and of the
    smaller sizes given; without sizes, of texts with fewer tokens the one window of all of them. With a bit map, of
    those that it has. A window has a row for each of its forms that differs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in A.slices(batches, "text"):
            p = parsed(A.column(batch, "text"), known)
            docs, text = A.column(batch, "id"), np.repeat(np.arange(batch.num_rows), p.sizes)
            place = np.arange(len(text)) - p.starts[text]
            for size in [n, *(range(1, n) if sizes is None else sizes)]:
                if len(text) < size:
                    continue
                own = p.sizes[text]
                fits = (place + size <= own if size == n or sizes is not None else own == size)[: len(text) - size + 1]
                if not fits.any():
                    continue
                fits &= (place + size <= own)[: len(fits)]
                for h, posted, kinds in forms(p, size, n):
                    take = fits & posted
                    if bitmap is not None:
                        bit = (h >> np.uint64(64 - BITS)).astype(np.int64)
                        take &= (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                    at = np.flatnonzero(take)
                    if not len(at):
                        continue
                    each = (at[:, None] + np.arange(size)).ravel()
                    ends = pa.array((np.arange(len(at) + 1) * size).astype(np.int32))
                    own_kinds = kinds[each].reshape(-1, size)
                    own_kinds[(own_kinds == 0).sum(axis=1) < PLAIN] = 0
                    yield pa.RecordBatch.from_arrays([
                        docs.take(pa.array(text[at])), pa.array(place[at].astype(np.int32)), pa.array(h[at].view(np.int64)), pa.array((own[at] - size + 1).astype(np.int32)),
                        pa.ListArray.from_arrays(ends, p.vocabulary.take(pa.array(p.word[each]))), pa.ListArray.from_arrays(ends, pa.array(own_kinds.ravel().astype(np.int32))),
                    ], ["id", "pos", "h", "n_windows", "words", "kinds"])

    return rows.mapInArrow(run, WINDOWS)


def _bitmap(items: DataFrame) -> np.ndarray:
    """2**BITS bits, set where an item's window hash begins; made on the executors, at most that many bytes / 8 here."""
    words = items.select(F.shiftrightunsigned("h", 64 - BITS).cast("int").alias("b")).groupBy(F.shiftright("b", 3).alias("at")).agg(F.expr("bit_or(shiftleft(1, b & 7))").alias("v")).toArrow()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    out[words.column("at").to_numpy()] = words.column("v").to_numpy().astype(np.uint8)
    return out


def leaks(docs: DataFrame, items: DataFrame, n: int = 5, cover: float = 0.5) -> DataFrame:
    """(doc_id, item_id, covered, n_windows, reworded) of docs (doc_id, text) that hold at least `cover` of the
    windows of an item (item_id, text) in chains with consistent slots. reworded: a slot's value differs."""
    posted = written(windows(items.where("item_id is not null").select(F.col("item_id").alias("id"), "text"), n), "items")
    short = [r[0] for r in posted.where(F.size("words") < n).select(F.size("words")).distinct().collect()]
    own = windows(docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text"), n, sorted(short), _bitmap(posted))
    own = written(own.select(F.col("id").alias("doc_id"), F.col("pos").alias("at"), "h", F.col("words").alias("said")), "hits")
    wanted = posted.select(F.col("id").alias("item_id"), "pos", "h", "n_windows", "words", "kinds").withColumn(
        "free", (F.count("*").over(Window.partitionBy("item_id", "h")) > 1) & ~F.exists("kinds", lambda k: k > 0))
    # The item's slots with the document's words in their places; other words are the same.
    zipped = F.arrays_zip(F.col("words").alias("x"), F.col("said").alias("y"), F.col("kinds").alias("kind"))
    alike = (F.size("said") == F.size("words")) & ~F.exists(zipped, lambda s: (s["kind"] == 0) & (s["x"] != s["y"]))
    # Windows without slots that the item repeats: that the document has them is all that counts, wherever.
    free = own.select("doc_id", "h", "said").distinct().join(wanted.where("free"), "h").where(alike).select("doc_id", "item_id", "pos", "n_windows")
    slots = F.transform(zipped, lambda s, i: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["kind"].alias("kind"), (F.col("pos") + i).alias("place")))
    chain = ["doc_id", "item_id", "diagonal"]
    pairs = own.join(wanted.where("not free"), "h").where(alike)
    pairs = written(pairs.select("doc_id", "item_id", (F.col("at") - F.col("pos")).alias("diagonal"), "pos", "n_windows", F.filter(slots, lambda s: s["kind"] > 0).alias("slots")).distinct(), "windows")
    each = pairs.select(*chain, "pos", "slots", F.explode("slots").alias("s")).select(*chain, "pos", "slots", "s.x", "s.y", "s.kind", "s.place")
    placed = each.select(*chain, "x", "y", "kind", "place").distinct()
    # A chain disagrees if the document keeps a number of the item in one place and changes it in another.
    broken = placed.groupBy(*chain, "x").agg(F.bool_or(F.col("x") == F.col("y")).alias("kept"), F.bool_or((F.col("kind") == 1) & (F.col("x") != F.col("y"))).alias("changed"))
    broken = broken.where("kept and changed").select(*chain).distinct()
    # Other conflicts: of the values for one of the item, that in most places stays (of equals the item's own, then the least); windows
    # with another one are dropped.
    best = Window.partitionBy(*chain, "x").orderBy(F.desc("places"), F.col("x") != F.col("y"), "y")
    losing = placed.groupBy(*chain, "x", "y").agg(F.count("*").alias("places")).withColumn("nth", F.row_number().over(best)).where("nth > 1").select(*chain, "x", "y")
    lost = each.join(losing, [*chain, "x", "y"], "left_semi").select(*chain, "pos", "slots").distinct()
    held = pairs.join(broken, chain, "left_anti").join(lost, [*chain, "pos", "slots"], "left_anti")
    covered = held.select("doc_id", "item_id", "pos", "n_windows").unionByName(free).distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("covered"), F.first("n_windows").cast("long").alias("n_windows"))
    covered = covered.where(F.col("covered") >= F.greatest(F.lit(1), F.ceil(F.col("n_windows") * cover)))
    reworded = held.groupBy(*chain).agg(F.bool_or(F.exists("slots", lambda s: s["x"] != s["y"])).alias("reworded")).groupBy("doc_id", "item_id").agg(F.min("reworded").alias("reworded"))
    return covered.join(reworded, ["doc_id", "item_id"], "left").withColumn("reworded", F.coalesce("reworded", F.lit(False)))


def decontaminated(docs: DataFrame, items: DataFrame, n: int = 5, cover: float = 0.5) -> DataFrame:
    """docs without those that leak an item."""
    bad = written(leaks(docs, items, n, cover).select("doc_id").distinct(), "leaks")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
