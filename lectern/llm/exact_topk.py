"""Exact top-k by inner product of quantised vectors: term-at-a-time accumulation.

Components become whole numbers, and a vector is a sparse row of its non-zero ones. Candidates are dealt by vec_id
into blocks; in a block each component has a posting list (which vectors, which values). A sparse query row goes through
its components one at a time: each posting list, weighted by the query's value, is added into a dense array with a score
for every vector of the block. Queries of a block share each list's walk, so scores are a matrix, a bounded piece at a
time. A partition selection finds the k-th best score, what reaches it is sorted, and the blocks' best are merged by a
window that cuts in each task before it shuffles.

The queries are a stated set, dealt into blocks too: a group is one block of each. Nothing is skipped, so the result
is exact whatever the values; a crowd of equal vectors is dealt like any others, by its ids.

Defined cases: vectors that are null or hold null or non-finite components take no part, as queries or candidates;
an empty or zero vector does, with scores of 0; of vectors of unlike lengths the shorter one counts as if it went on with
zeros; a null id takes no part; rows repeated in id and vector count once; an id with several vectors asks
with each of them, and the best score of each pair of ids counts; ties go to the smaller id; other columns are ignored;
an empty table gives no rows. Where sums could pass 64 bits they are made in Python's whole numbers, and a score beyond
them counts as the nearest 64-bit number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import written

BLOCK, QUERIES = 8192, 2048
#: Scores held at once.
CELLS = 4 << 20
RESULT = "query_id bigint, vec_id bigint, score bigint"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(v: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole numbers: of 64 bits, or Python's where they don't fit."""
    if np.abs(v).max(initial=0) * scale < 2.0**62:
        return np.floor(scale * v).astype(np.int64)
    return np.array([math.floor(Fraction(scale) * Fraction(x)) for x in v.tolist()], object)


class Postings:
    """For each component the vectors of a block that have it, and their values."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray):
        self.rows = len(sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        component = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        held = np.flatnonzero(values != 0)
        held = held[np.argsort(component[held], kind="stable")]
        self.of, starts = np.unique(component[held], return_index=True)
        self.row, self.value, self.bounds = row[held], values[held], [*starts.tolist(), len(held)]

    def lists(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for n, c in enumerate(self.of.tolist()):
            a, b = self.bounds[n], self.bounds[n + 1]
            yield c, self.row[a:b], self.value[a:b]


def accumulated(index: Postings, queries: list[np.ndarray], kind: type) -> np.ndarray:
    """The scores of all vectors of a block for each query."""
    scores = np.zeros((len(queries), index.rows), kind)
    for component, rows, values in index.lists():
        weight = np.array([q[component] if component < len(q) else 0 for q in queries], kind)
        asking = np.flatnonzero(weight)
        if len(asking) == len(queries) and len(rows) == index.rows:
            scores += weight[:, None] * values[None, :]
        elif len(asking):
            scores[asking[:, None], rows[None, :]] += weight[asking, None] * values[None, :]
    return scores if kind is np.int64 else np.minimum(np.maximum(scores, LEAST), MOST).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best distinct ids but the query's own; ids are sorted."""
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    if len(first) < len(ids):
        scores, ids = np.maximum.reduceat(scores, first, axis=1), ids[first]
    for n in range(len(scores)):
        others = np.flatnonzero(ids != own[n])
        s = scores[n][others]
        if len(s) > k:
            line = np.partition(s, len(s) - k)[len(s) - k]
            others = others[s >= line]
            s = scores[n][others]
        order = np.lexsort((ids[others], ~s))[:k]
        yield n, ids[others[order]], s[order]


def searched(ids: np.ndarray, sizes: np.ndarray, values: np.ndarray, asks: np.ndarray, queries: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) over a block of vectors, sorted by id."""
    index = Postings(sizes, values)
    most = max((int(np.abs(q).max(initial=0)) for q in queries), default=0) * int(np.abs(values).max(initial=0)) * max(1, int(sizes.max(initial=0)))
    kind = np.int64 if most <= MOST and values.dtype != object and all(q.dtype != object for q in queries) else object
    step = max(1, CELLS // max(1, len(ids)))
    for at in range(0, len(queries), step):
        scores = accumulated(index, queries[at : at + step], kind)
        for n, found, score in best(scores, ids, asks[at : at + step], k):
            yield int(asks[at + n]), found, score


def nearest(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each row of vectors (vec_id, embedding) where `queries` holds."""
    v = F.col("embedding").cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & good).select("vec_id", v.alias("v"), F.coalesce(queries, F.lit(False)).alias("query"))
    rows = written(rows.groupBy(F.col("vec_id").cast("long").alias("vec_id"), "v").agg(F.max("query").alias("query")), "vectors")
    n, asking = rows.agg(F.count("*"), F.count_if("query")).first()
    right, left = -(-n // block), -(-asking // query_block)
    if not left:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("bigint").alias("score"))
    own, every = F.xxhash64("vec_id"), lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    held = rows.select("vec_id", "v", F.lit(False).alias("query"), F.pmod(own, F.lit(right)).cast("int").alias("i"), every(left).alias("j"))
    asks = rows.where("query").select("vec_id", "v", "query", every(right).alias("i"), F.pmod(own, F.lit(left)).cast("int").alias("j"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        asking = np.array(group.column("query").to_pylist(), bool)
        ids, v = group.column("vec_id").to_numpy(), group.column("v").combine_chunks()
        sizes = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = quantised(v.flatten().to_numpy(zero_copy_only=False), scale)
        ends = np.cumsum(sizes)
        asked = [values[ends[i] - sizes[i] : ends[i]] for i in np.flatnonzero(asking)]
        found = list(searched(ids[~asking], sizes[~asking], values[np.repeat(~asking, sizes)], ids[asking], asked, k)) if asked and not asking.all() else []
        score = np.concatenate([s for _, _, s in found]) if found else np.zeros(0, np.int64)
        return pa.table({
            "query_id": pa.array(np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64)),
            "vec_id": pa.array(np.concatenate([i for _, i, _ in found]) if found else [], pa.int64()),
            "score": pa.array(score, pa.int64()),
        })

    met = held.unionByName(asks).groupBy("i", "j").applyInArrow(run, RESULT).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
