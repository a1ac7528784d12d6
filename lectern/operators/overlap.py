"""Which pairs of a book and a candidate share a value with another book of the candidate.

A book is one row: its candidates and, by kind, its values. What candidates hold is written in files of about HELD rows (kind,
candidate, value, only), each candidate's in one. Tasks take books with about PAIRS candidates at a time and go through the files, so
lists are not sent to each candidate and pairs are not shuffled again; what a task holds is bounded by both numbers and by the values
of one book. Of a pair's two lists the shorter one is looked up in the other, a few values first, and no further once one is found.
Ids are whole numbers.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.versions import Files, shared_folder

# Tasks get this module's functions by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a file of what candidates hold; candidates of books that a task looks at together; values looked up at once.
HELD, PAIRS, AT_ONCE = 1 << 21, 1 << 21, 1 << 20
#: Values of a pair that are looked up first; each further step takes four times as many.
FIRST = 4


def _files(rows: DataFrame, name: str, *order: str) -> tuple[str, list[str]]:
    """(folder, names of files) of rows dealt by candidate, each file in order."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)
    return path, [n for n in Files(rows.sparkSession, path).names() if n.endswith(".parquet")]


def _read(path: str, name: str) -> pa.Table:
    at, where = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pq.read_table(f"{where}/{name}", filesystem=at).combine_chunks()


def found_at(values: np.ndarray, start: np.ndarray, size: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted one in its own sorted slice of values (start, size: 1 at least), -1 where it isn't there."""
    low, n = start.copy(), size.copy()
    while len(n) and n.max() > 1:
        half = n >> 1
        low += np.where(values[low + half] <= wanted, half, 0)
        n -= half
    return np.where(values[low] == wanted, low, -1)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of lists of numbers."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def _groups(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of about AT_ONCE in all, or of one."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield slice(at, end)
        at = end


class Block:
    """Some books: pairs in order of their candidates, and by kind the books' values."""

    def __init__(self, table: pa.Table, kinds: int):
        self.book = table.column("book_id").to_numpy()
        self.offsets, self.candidate = _flat(table.column("asked"))
        self.row = np.repeat(np.arange(len(self.book)), np.diff(self.offsets))
        self.order = np.argsort(self.candidate, kind="stable")
        self.ordered = self.candidate[self.order]
        self.kinds = [_flat(table.column(f"of_{k}")) for k in range(kinds)]
        self.found = np.zeros(len(self.candidate), np.int8)

    def pairs_of(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, which of the sorted distinct candidates theirs is)"""
        begin, end = (np.searchsorted(self.ordered, candidates, side) for side in ("left", "right"))
        n = end - begin
        return self.order[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], np.repeat(np.arange(len(candidates)), n)

    def look(self, k: int, candidate: np.ndarray, value: np.ndarray, only: np.ndarray, many: np.ndarray) -> None:
        """Mark pairs with a value of kind k that their candidate holds: rows (candidate, value) in order, only: the one book, unless many."""
        start = np.flatnonzero(np.concatenate([[True], candidate[1:] != candidate[:-1]]))
        size = np.diff(np.concatenate([start, [len(candidate)]]))
        pair, which = self.pairs_of(candidate[start])
        offsets, mine = self.kinds[k]
        row = self.row[pair]
        n = offsets[row + 1] - offsets[row]
        for own in (True, False):
            chosen = np.flatnonzero((n > 0) & ((n <= size[which]) == own))
            t, j, i = pair[chosen], which[chosen], row[chosen]
            lists = (offsets[i], n[chosen], mine), (start[j], size[j], value)
            (x, length, asked), (y, others, sought) = lists if own else lists[::-1]
            at, width = 0, FIRST
            while len(t):
                taken = np.minimum(length - at, width)
                hit = np.zeros(len(t), bool)
                for g in _groups(taken):
                    m = taken[g]
                    first = np.cumsum(m) - m
                    place = np.repeat(x[g] + at - first, m) + np.arange(int(m.sum()))
                    met = found_at(sought, np.repeat(y[g], m), np.repeat(others[g], m), asked[place])
                    held = met if own else place
                    hit[g] = np.logical_or.reduceat((met >= 0) & (many[held] | (only[held] != np.repeat(self.book[i[g]], m))), first)
                self.found[t[hit]] |= 1 << k
                at += width
                rest = np.flatnonzero(~hit & (length > at))
                t, i, x, length, y, others = (a[rest] for a in (t, i, x, length, y, others))
                width = min(width * 4, AT_ONCE)


def shared(pairs: DataFrame, owners: DataFrame, kinds: list[tuple[DataFrame, DataFrame | None]], parts: int, names: DataFrame | None = None) -> DataFrame:
    """(book_id, candidates, found[, displays]), a row for each book of pairs (book_id, candidate): its candidates, and for each the
    sum of 2 ** k over the kinds k of which the book shares a value with another book of the candidate. A kind: (book_id, value) of
    books, and (candidate, value, book_id) or, if None, the values of the books of owners (book_id, candidate). Nulls take no part.
    names (candidate, display): only candidates with a name are listed, once for each."""
    tagged = [pairs.select("book_id", "candidate"), owners.select("book_id", "candidate"), *(of_book for of_book, _ in kinds)]
    columns = ["asked", "owners", *(f"of_{k}" for k in range(len(kinds)))]
    rows = [t.select(F.col(t.columns[0]).cast("long").alias("book_id"), F.lit(i).alias("tag"), F.col(t.columns[1]).cast("long").alias("value")).dropna() for i, t in enumerate(tagged)]
    union = rows[0]
    for more in rows[1:]:
        union = union.unionByName(more)
    sets = [F.sort_array(F.collect_set(F.when(F.col("tag") == i, F.col("value")))).alias(c) for i, c in enumerate(columns)]
    path = f"{shared_folder(pairs.sparkSession)}/books-{uuid.uuid4().hex}"
    grouped = union.repartition(parts, "book_id").groupBy("book_id").agg(*sets)
    grouped.write.option("compression", "zstd").parquet(path)
    lists = pairs.sparkSession.read.schema(grouped.schema).parquet(path)

    derived = [k for k, (_, of_entity) in enumerate(kinds) if of_entity is None]
    size = lists.agg(F.sum(F.size("owners").cast("long") * sum(F.size(f"of_{k}") for k in derived))).first()[0] or 0
    files = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-size // HELD))
    value = F.concat(*(F.arrays_zip(F.array_repeat(F.lit(k), F.size(f"of_{k}")).alias("kind"), F.col(f"of_{k}").alias("value")) for k in derived))
    owned = lists.where(F.size("owners") > 0).select(F.explode("owners").alias("candidate"), "book_id", *(f"of_{k}" for k in derived)).repartition(files, "candidate")
    of = [(owned.select("candidate", "book_id", F.explode(value).alias("x")).select("candidate", "book_id", "x.kind", "x.value"), derived)]
    for k, (_, of_entity) in enumerate(kinds):
        if of_entity is not None:
            one = of_entity.select(F.col("candidate").cast("long").alias("candidate"), F.col("book_id").cast("long").alias("book_id"), F.lit(k).alias("kind"), F.col("value").cast("long").alias("value"))
            of.append((one.dropna().repartition(files, "candidate"), [k]))
    held = []
    for entity, own in of:
        low = entity.groupBy("candidate", "kind", "value").agg(F.min("book_id").alias("low"), F.max("book_id").alias("high"))
        folder, found = _files(low.select("kind", "candidate", "value", F.when(F.col("low") == F.col("high"), F.col("low")).alias("only")), "held", "kind", "candidate", "value")
        held += [(folder, n, own) for n in found]
    called = None
    if names is not None:
        dealt = names.select(F.col("candidate").cast("long").alias("candidate"), F.col("display").cast("string").alias("display")).where("candidate IS NOT NULL")
        called = _files(dealt.repartition(max(1, -(-names.count() // HELD)), "candidate"), "names", "candidate")
    return lists.where(F.size("asked") > 0).drop("owners").mapInArrow(_compared(len(kinds), held, called, PAIRS), "book_id bigint, candidates array<bigint>, found array<tinyint>" + (", displays array<string>" if called else ""))


def _compared(kinds: int, held: list[tuple[str, str, list[int]]], called: tuple[str, list[str]] | None, most: int):
    def named(block: Block) -> tuple[np.ndarray, pa.Array]:
        """(the pair, the name) of each name of a pair, in order of pairs."""
        pair, display = [np.zeros(0, np.int64)], [pa.array([], pa.string())]
        for name in called[1]:
            table = _read(called[0], name)
            candidate = table.column("candidate").to_numpy()
            if len(candidate):
                start = np.flatnonzero(np.concatenate([[True], candidate[1:] != candidate[:-1]]))
                size = np.diff(np.concatenate([start, [len(candidate)]]))
                t, which = block.pairs_of(candidate[start])
                n = size[which]
                pair.append(np.repeat(t, n))
                place = np.repeat(start[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                display.append(table.column("display").combine_chunks().take(pa.array(place)).cast(pa.string()))
        pair = np.concatenate(pair)
        order = np.argsort(pair, kind="stable")
        return pair[order], pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in display]).take(pa.array(order))

    def looked(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(pa.Table.from_batches(batches), kinds)
        for folder, name, own in held:
            table = _read(folder, name)
            kind = table.column("kind").to_numpy()
            for k in own:
                rows = table.slice(int(np.searchsorted(kind, k)), int(np.searchsorted(kind, k, "right") - np.searchsorted(kind, k)))
                if rows.num_rows:
                    only = rows.column("only")
                    block.look(k, rows.column("candidate").to_numpy(), rows.column("value").to_numpy(), only.fill_null(0).to_numpy(), only.is_null().to_numpy())
        pair, columns = np.arange(len(block.candidate)), ["book_id", "candidates", "found"]
        offsets, more = block.offsets, []
        if called:
            pair, display = named(block)
            offsets, more = np.searchsorted(pair, block.offsets), [display]
            columns.append("displays")
        offsets = pa.array(offsets.astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(block.candidate[pair]), pa.array(block.found[pair]), *more)]
        out = pa.RecordBatch.from_arrays([pa.array(block.book), *lists], columns)
        for at in range(0, out.num_rows, 10_000):
            yield out.slice(at, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, size = [], 0
        for b in batches:
            taken.append(b)
            size += len(b.column(b.schema.names.index("asked")).flatten())
            if size >= most:
                yield from looked(taken)
                taken, size = [], 0
        if taken:
            yield from looked(taken)

    return run
