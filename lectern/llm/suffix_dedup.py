"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that also starts elsewhere.

In five steps, that lose no repeat whatever the size. What is taken for equal is equal in hashes, not compared byte by
byte: contexts in 128 bits (64 of the seed, 64 of the whole context), bytes beside a parted seed in 64 beside the seed's
64; a document is known by 64 bits of its id and text.

1. Seeds: each window of `length` bytes selects its k-grams of least hash, so equal windows select equal
   k-grams at equal places. About two positions in (length - k + 2) are seeds. A seed's context is what
   the windows that can select it cover. Rows: seed hash, context hash, document, position.
2. Seeds that occur once end here. A context that occurs twice is marked whole.
3. Of seeds with several contexts, one copy of each distinct context is fetched and indexed with the
   others in bounded blocks. A block's index is a run-length Burrows-Wheeler transform of the aligned
   contexts: suffixes sorted by (place, following bytes), each place's order from the next one's; only
   where a run of preceding bytes ends is the match with the neighbour measured. Streaming over the
   text, a match is at least the match one byte before, less one; that gives each window's longest
   match, and long ones are marked. A seed with too many contexts for a block is parted by the bytes beside it, by
   hashes that Spark groups, until its blocks are bounded or all in a block share their windows.
4. Marks go back to all occurrences and are united per document.
5. Bytes marked are cut out.

Scale: rows are of seeds that occur twice at least, after a count with map-side sums; texts are
shuffled twice, by document. No key's rows meet in one task but in bounded blocks; hot contexts are
joined with both sides shuffled, so AQE can split them.

Defined cases: null texts are empty; texts under `length` bytes lose nothing; repeated rows are copies
of each other; null ids are kept; other columns are kept, but for columns `kept`, `removed` and `n_bytes` of docs, which
the results replace; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import arrow_text as A
from lectern.llm.shared import discard, written

LENGTH, GRAM = 200, 64
PIECE = 1 << 20
BLOCK_BYTES, MOST_CONTEXTS = 2 << 20, 1024
#: Hashes of rows that more than one row may have.
MOST_SHARED = 10_000
INVERSE = pow(A.MULTIPLIER, -1, 1 << 64)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, A.MULTIPLIER, np.uint64)
        down = np.full(n, INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of x over each run of `width`."""
    size = 1
    while size * 2 <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash, never 0, of the k bytes from each place on; k is a power of 2."""
    with np.errstate(over="ignore"):
        h, size, factor = A.BYTE_VALUE[data], 1, A.MULTIPLIER
        while size < k:
            h = h[:-size] * np.uint64(factor) + h[size:]
            size, factor = size * 2, factor * factor & A.M64
    return A.mix(h) | np.uint64(1)


def seed_positions(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the seeds of the texts that end at `ends` in data."""
    places, hashes = [], []
    width = length - k + 1
    for start in range(0, max(0, len(data) - length + 1), PIECE):
        own = data[start : start + PIECE + length - 1]
        if len(own) < length:
            break
        v = gram_hashes(own, k)
        low = _sliding(v, width, np.minimum)
        inside = np.searchsorted(ends, np.arange(start, start + len(low)), "right")
        low[ends[inside] < np.arange(start, start + len(low)) + length] = 0
        padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
        chosen = np.flatnonzero(_sliding(padded, width, np.maximum) == v)
        places.append(chosen + start)
        hashes.append(v[chosen])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def _context_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, left: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            base = int(start[at])
            end = max(at + 1, int(np.searchsorted(start, base + PIECE)))
            last = int(stop[at:end].max())
            up, down = _powers(2 * PIECE)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(A.BYTE_VALUE[data[base:last]] * up[: last - base])])
            s, e = start[at:end] - base, stop[at:end] - base
            h = (total[e] - total[s]) * down[s]
            out[at:end] = A.mix(h + (e - s).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + left[at:end].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            at = end
    return out


def seeds(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Rows (key, pos, before, size, seed, ctx) of docs (key, text): the context is the `size` bytes from
    pos - before on."""
    reach = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text", PIECE):
            data, offsets = A.text_buffers(A.column(batch, "text"))
            pos, seed = seed_positions(data, offsets[1:], length, k)
            doc = np.searchsorted(offsets, pos, "right") - 1
            begin, end = offsets[doc], offsets[doc + 1]
            start, stop = np.maximum(begin, pos - reach), np.minimum(end, pos + k + reach)
            ctx = _context_hashes(data, start, stop, pos - start)
            keys = A.column(batch, "key").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array((pos - begin).astype(np.int32)), pa.array((pos - start).astype(np.int16)), pa.array((stop - start).astype(np.int16)), pa.array(seed.view(np.int64)), pa.array(ctx.view(np.int64))],
                ["key", "pos", "before", "size", "seed", "ctx"],
            )

    return docs.mapInArrow(run, "key bigint, pos int, before smallint, size smallint, seed bigint, ctx bigint")


class RunLengthIndex:
    """The index of a block of aligned contexts: place by place from the right, the order of the suffixes that
    start there (from the order one place on, by a stable sort on one byte), and the ends of the runs of
    preceding bytes in it. Only places where a window of `length` bytes can start are measured."""

    #: Pairs measured at a time.
    PAIRS = 1 << 18

    def __init__(self, contexts: list[bytes], before: list[int], length: int):
        """before: bytes of each context in front of the place that all are aligned at."""
        self.sizes, self.before, self.length = np.array([len(c) for c in contexts]), np.array(before), length
        self.text = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.lead = int(self.before.max())
        width = self.lead + int((self.sizes - self.before).max())
        self.measured = max(0, width - length + 1)
        row = np.repeat(np.arange(len(contexts)), self.sizes)
        column = np.arange(len(row)) - np.repeat(self.starts + self.before, self.sizes) + self.lead
        self.columns = np.zeros((width, len(contexts)), np.uint16)
        self.columns[column, row] = self.text[:-8] + np.uint16(1)  # 0: outside of the context

    def run_ends(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(column, contexts, contexts next to them in the order) where a run of preceding bytes ends."""
        order = np.arange(len(self.sizes))
        for c in range(len(self.columns) - 1, -1, -1):
            own = self.columns[c][order]
            by = np.argsort(own, kind="stable")
            order = order[by]
            if c < self.measured:
                inside = order[np.searchsorted(own[by], 1) :]
                preceding = self.columns[c - 1][inside] if c else np.zeros(len(inside), np.uint16)
                ends = np.flatnonzero((preceding[1:] != preceding[:-1]) | (preceding[1:] == 0))
                if len(ends):
                    yield c, inside[ends], inside[ends + 1]

    def matches(self) -> np.ndarray:
        """The longest match of each context's suffix at each measured column with its neighbours in the
        order, measured at run ends only and streamed over the text: less one a byte."""
        out = np.zeros((len(self.sizes), self.measured), np.int32)
        flat, held, parts = out.reshape(-1), 0, []

        def measure() -> None:
            c, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            common = self._common(c, a, b)
            for own in (a, b):
                np.maximum.at(flat, own * self.measured + c, common)

        for c, a, b in self.run_ends():
            parts.append((np.full(len(a), c), a, b))
            held += len(a)
            if held >= self.PAIRS:
                measure()
                held, parts = 0, []
        if parts:
            measure()
        at = np.arange(self.measured, dtype=np.int32)
        return np.maximum.accumulate(out + at, axis=1) - at

    def _common(self, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes contexts a and b have in common from column c on."""
        x, y = ((self.starts + self.before)[r] + c - self.lead for r in (a, b))
        most = np.minimum((self.starts + self.sizes)[a] - x, (self.starts + self.sizes)[b] - y)
        eight = np.lib.stride_tricks.sliding_window_view(self.text, 8)
        done, live = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(live):
            at = done[live]
            differ = eight[x[live] + at] != eight[y[live] + at]
            some = differ.any(axis=1)
            done[live] += np.where(some, differ.argmax(axis=1), 8)
            live = live[~some & (done[live] < most[live])]
        return np.minimum(done, most).astype(np.int32)

    def covered(self) -> tuple[np.ndarray, np.ndarray]:
        """Per context the first and the last column at which a window starts that another context has at the
        same place; -1 for none."""
        long = self.matches() >= self.length
        some = long.any(axis=1) if self.measured else np.zeros(len(self.sizes), bool)
        if not some.any():
            return np.full(len(some), -1), np.full(len(some), -1)
        return np.where(some, long.argmax(axis=1), -1), np.where(some, self.measured - 1 - long[:, ::-1].argmax(axis=1), -1)


def marked(contexts: list[bytes], before: list[int], length: int) -> list[list[tuple[int, int]]]:
    """Per context, the runs of bytes (from its start) covered by windows that another context has at the
    same place."""
    index = RunLengthIndex(contexts, before, length)
    shift = index.before - index.lead
    return [_runs(np.flatnonzero(m >= length) + s, length) for m, s in zip(index.matches(), shift, strict=True)]


def _runs(windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The union of the windows of `length` bytes that start at these places, ascending."""
    if not len(windows):
        return []
    gaps = np.flatnonzero(np.diff(windows) > length)
    first = windows[np.concatenate([[0], gaps + 1])]
    last = windows[np.concatenate([gaps, [len(windows) - 1]])] + length
    return list(zip(first.tolist(), last.tolist(), strict=True))


#: The column of runs beside a document's own; one of this name could not be told from it.
RUNS = "\x01runs"
MARKS = "seed bigint, ctx bigint, s int, e int"


def mark_blocks(contexts: DataFrame, length: int) -> DataFrame:
    """Marks of contexts (block, seed, ctx, before, bytes), found by an index of each block's contexts together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            # All windows of a context hold its seed, so what they cover is one run.
            index = RunLengthIndex([r[3] for r in rows], [r[2] for r in rows], length)
            first, last = index.covered()
            shift = index.before - index.lead
            found = [(rows[i][0], rows[i][1], int(first[i] + shift[i]), int(last[i] + shift[i]) + length) for i in np.flatnonzero(first >= 0)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kinds[k]) for k in range(4)], ["seed", "ctx", "s", "e"])

        for batch in batches:
            for row in zip(*(A.column(batch, c).to_pylist() for c in ("seed", "ctx", "before", "bytes", "block")), strict=True):
                if rows and held >= BLOCK_BYTES and rows[-1][4] != row[4]:
                    yield flush()
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        if rows:
            yield flush()

    return contexts.repartition("block").sortWithinPartitions("block").mapInArrow(run, MARKS)


def bounded_blocks(contexts: DataFrame, length: int, k: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(contexts to be indexed by their column `block`, marks found on the way) of contexts (seed, ctx, before,
    bytes) of seeds with more contexts than a block takes.

    The windows around a seed start from `lo` to `hi` places beside it. A range of starts is halved; windows of a half
    all hold the bytes from hi to lo + length, so contexts that share one of them agree there: these bytes' hash parts
    each half's contexts into blocks. Contexts that are alike over all windows of a half are marked there, and one stays
    for them; one alone in its block shares no other window of the half. Blocks that are still too large are halved
    again. Contexts in a block of a range of one window are all alike, so this ends."""
    ranges = contexts.withColumns({"lo": F.lit(k - length), "hi": F.lit(0)})
    blocks, marks, key = [], [], ["seed", "lo", "hi", "h"]
    before, lo, hi = F.col("before"), F.col("lo"), F.col("hi")
    first, last = F.greatest(lo, -before), F.least(hi, F.octet_length("bytes") - before - length)

    def part(start, stop):
        return F.substring("bytes", (before + start + 1).cast("int"), (stop - start).cast("int"))

    while ranges is not None:
        middle = F.floor((lo + hi) / 2).cast("int")
        two = F.array(F.struct(lo, middle.alias("hi")), F.struct((middle + 1).alias("lo"), hi))
        rows = ranges.select("seed", "ctx", "before", "bytes", F.explode(two).alias("x")).select("seed", "ctx", "before", "bytes", "x.*")
        rows = rows.where((lo <= hi) & (first <= last)).withColumns({
            "h": F.xxhash64(part(hi, lo + length)), "g": F.xxhash64(first, last, part(first, last + length)), "s": before + first, "e": before + last + length})
        rows = written(rows, "halves")
        alike = rows.groupBy(*key, "g").agg(F.count("*").alias("n"), F.min(F.struct("ctx", "before", "bytes")).alias("one"))
        # Written first: a join on both sides' plain shuffles is one that adaptive execution can split at a hot key.
        alike = written(alike, "alike")
        sizes = written(alike.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        marks.append(written(rows.join(alike.where("n > 1").select(*key, "g"), [*key, "g"]).select("seed", "ctx", "s", "e"), "alike_marks"))
        rest = written(alike.join(sizes, key).select(*key, "size", "one.*"), "rest")
        discard(rows, alike, sizes)
        blocks.append(rest.where(f"size <= {MOST_CONTEXTS}").select("seed", "ctx", "before", "bytes", F.xxhash64(*key).alias("block")))
        large = rest.where(f"size > {MOST_CONTEXTS}")
        ranges = large.select("seed", "ctx", "before", "bytes", "lo", "hi") if large.limit(1).count() else None
    return blocks, marks


def with_partners(contexts: DataFrame, length: int, k: int) -> DataFrame:
    """Contexts (seed, ctx, n, before, bytes) that may share a window: a window reaches far enough beyond the seed
    on one side at least, so two that share one agree there. Others are dropped, before the index."""
    reach = (length - k + 1) // 2
    n = F.octet_length("bytes")
    right = F.when(n - F.col("before") >= k + reach, F.xxhash64(F.substring("bytes", F.col("before") + 1, F.lit(k + reach))))
    left = F.when(F.col("before") >= reach, F.xxhash64(F.substring("bytes", F.col("before") - reach + 1, F.lit(reach + k))))
    rows = written(contexts.withColumns({"right": right, "left": left}), "sides")
    both = rows.select("seed", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("right").alias("h")), F.struct(F.lit(1).alias("side"), F.col("left").alias("h")))).alias("x")).select("seed", "x.*").where("h IS NOT NULL")
    twice = written(both.groupBy("seed", "side", "h").count().where("count > 1").drop("count"), "agreed")
    keys = rows.select("seed", "ctx", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("right").alias("h")), F.struct(F.lit(1).alias("side"), F.col("left").alias("h")))).alias("x")).select("seed", "ctx", "x.*")
    kept = keys.join(twice, ["seed", "side", "h"], "left_semi").select("seed", "ctx").distinct()
    return rows.drop("right", "left").join(kept, ["seed", "ctx"], "left_semi")


def repeated_runs(docs: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """(key, runs) of docs (key, text): where a key's text has repeated strings, as runs of bytes that may
    overlap. Rows of one key hold one text."""
    found = written(seeds(docs, length, k), "seeds")
    twice = written(found.groupBy("seed").count().where("count > 1").select("seed"), "twice")
    at = written(found.join(twice, "seed"), "occurrences")
    discard(found, twice)
    ctx = written(
        at.groupBy("seed", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos", "before", "size")).alias("at")), "contexts")
    several = ctx.groupBy("seed").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1")
    open_ = ctx.join(written(several.select("seed"), "several"), "seed").select("seed", "ctx", "n", "at.*")
    texts = docs.select("key", "text").dropDuplicates(["key"])
    raw = F.substring(F.col("text").cast("binary"), F.col("pos") - F.col("before") + 1, F.col("size").cast("int"))
    bytes_ = with_partners(open_.join(texts, "key").select("seed", "ctx", "n", F.col("before").cast("int").alias("before"), raw.alias("bytes")), length, k)
    bytes_ = written(bytes_, "partners")
    sizes = written(bytes_.groupBy("seed").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1").drop("least"), "sizes")
    bytes_ = bytes_.join(sizes, "seed").drop("n")
    small = bytes_.where(F.col("contexts") <= MOST_CONTEXTS).drop("contexts").withColumn("block", F.col("seed"))
    blocks, marks = [small], []
    if sizes.where(F.col("contexts") > MOST_CONTEXTS).limit(1).count():
        more, marks = bounded_blocks(bytes_.where(F.col("contexts") > MOST_CONTEXTS).drop("contexts"), length, k)
        blocks += more
    marks = reduce(DataFrame.unionByName, marks, mark_blocks(reduce(DataFrame.unionByName, blocks), length))
    # A context can lie in several blocks. All its windows hold the seed, so what they cover together is one run.
    marks = marks.groupBy("seed", "ctx").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    single = ctx.where("n = 1").select("seed", "ctx")
    whole = ctx.where("n > 1").select("seed", "ctx", F.lit(0).alias("s"), F.col("at.size").cast("int").alias("e"))
    marks = written(whole.unionByName(marks.join(single, ["seed", "ctx"], "left_semi")), "marks")
    run = F.struct((F.col("pos") - F.col("before") + F.col("s")).alias("s"), (F.col("pos") - F.col("before") + F.col("e")).alias("e"))
    return at.join(marks, ["seed", "ctx"]).select("key", run.alias("run")).groupBy("key").agg(F.collect_set("run").alias("runs"))


def _united(runs: list | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((r["s"], r["e"]) for r in runs or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def hashed(rows: DataFrame, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col("doc_id"), F.col("text"))


def identity(docs: DataFrame) -> Column:
    """A number for each different row (doc_id, text): a 64-bit hash, and for rows whose hash another row has as well, as a second
    one tells, one of another salt; looked at again until no two rows share a number. Only such hashes come to the driver: three are
    expected of 10^10 rows, and more than MOST_SHARED are an error."""
    own = hashed(docs, 0)
    for salt in range(1, 16):
        shared = docs.select(own.alias("key"), hashed(docs, -salt).alias("other")).groupBy("key").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b")
        again = [r.key for r in shared.select("key").limit(MOST_SHARED + 1).collect()]
        if not again:
            return own
        if len(again) > MOST_SHARED:
            raise ValueError("hashes of different rows agree too often")
        own = F.when(own.isin(again), hashed(docs, salt)).otherwise(own)
    raise ValueError("hashes of different rows agree too often")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = GRAM, whole_characters: bool = False) -> DataFrame:
    """docs with `kept` (the bytes that stay), `removed` (runs of bytes as arrays [from, to]) and n_bytes.
    With whole_characters, a character that a run covers in part stays."""
    names = [c for c in docs.columns if c not in ("kept", "removed", "n_bytes")]
    own = identity(docs)
    runs = repeated_runs(docs.select(own.alias("key"), "text"), length, k)
    # The document's columns travel in a struct, so none of their names can clash.
    packed = docs.select(own.alias("key"), F.struct(*[docs[c] for c in names]).alias("row"))
    joined = packed.join(runs, "key", "left").select(*[F.col("row")[c].alias(c) for c in names], F.col("runs").alias(RUNS))
    schema = T.StructType([*joined.drop(RUNS).schema.fields, T.StructField("kept", T.BinaryType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("n_bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            kept, removed, sizes = [], [], []
            for text, found in zip(A.column(batch, "text").to_pylist(), A.column(batch, RUNS).to_pylist(), strict=True):
                raw = (text or "").encode()
                sizes.append(len(raw))
                cut = _united(found)
                if whole_characters:
                    inner = []
                    for s, e in cut:
                        while s < e and raw[s] & 0xC0 == 0x80:
                            s += 1
                        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                            e -= 1
                        if s < e:
                            inner.append((s, e))
                    cut = inner
                at, parts = 0, []
                for s, e in cut:
                    parts.append(raw[at:s])
                    at = e
                kept.append(b"".join([*parts, raw[at:]]))
                removed.append([[s, e] for s, e in cut])
            yield pa.RecordBatch.from_arrays(
                [*(A.column(batch, c) for c in names), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.list_(pa.int32()))), pa.array(sizes, pa.int64())],
                [*names, "kept", "removed", "n_bytes"],
            )

    return joined.mapInArrow(run, schema)
