"""Approximate nearest neighbours by inner product with a permutation index.

Each vector is represented by its nearest pivots in order (by cosine) and posted in the inverted files of the first
POSTED of them. A query reads the files of its own first POSTED pivots and no others; in each it ranks what it meets by
the footrule distance of the orders (a pivot absent from one counts as just past its end), and re-ranks the best share
by the exact inner product in double precision. A vector that stands in several of the query's files is met in the
first of them only, so nothing is scored twice.

Files are groups of Spark rows (length, pivot); one with more vectors or queries than a block holds is dealt into
blocks of each, so no task grows with a crowd around one pivot. Shuffled are POSTED rows a vector, POSTED rows a query
(times the blocks of its files) and at most k results of each file that a query reads. Of equal vectors the k + 1
smallest ids are posted: no others can be among the k nearest of anything.

The pivots are a bounded sample (by hash) of distinct vectors. All vectors are indexed; those of another length than
the pivots' have one file for each length, which is searched whole.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components take no part, as
queries or candidates; vectors of another length than a query's are no candidates of it; equal
vectors are each a candidate; ties go to the smaller id; a null id takes no part; rows repeated in id and vector count
once; an id with several vectors asks with each of them, and the best score of each pair of ids counts; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm import arrow_text as A
from lectern.llm.shared import discard, written

PIVOTS, ORDER, POSTED = 256, 64, 16
INDEX_BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Of a file, the share that is re-ranked and the least number.
SHARE, FLOOR = 0.3, 60
#: Orders this close (of the largest saving) are all candidates: a crowd of near copies is ranked too finely to cut.
CLOSE = 0.6
RESULT = "query_id bigint, vec_id bigint, score double"


def valid(v: Column) -> Column:
    """Whether a vector takes part."""
    v = v.cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0)


def pivots(vectors: DataFrame, most: int) -> np.ndarray:
    """At most `most` vectors of the commonest length, of unit length: of a bounded sample of distinct vectors
    (8 times as many, chosen by hash), those that lie farthest from the ones before, so a crowd of
    near copies gives one pivot."""
    size = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not size:
        return np.zeros((0, 1))
    some = vectors.where(F.size("v") == size[0][0]).select("v", F.xxhash64("v").alias("h")).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(8 * most).toArrow()
    x = np.array(some.column("v").to_pylist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(most, len(x)):
        far = int(near.argmin())
        if near[far] > 0.999:
            break
        chosen.append(far)
        near = np.maximum(near, x @ x[far])
    return x[chosen]


def orders(x: np.ndarray, of: np.ndarray, depth: int) -> np.ndarray:
    """The `depth` nearest pivots of each row of x, nearest first; ties to the smaller pivot."""
    near = -(x @ of.T)
    depth = min(depth, of.shape[0])
    few = np.argpartition(near, depth - 1, axis=1)[:, :depth] if depth < of.shape[0] else np.tile(np.arange(depth), (len(x), 1))
    few.sort(axis=1)
    return np.take_along_axis(few, np.argsort(np.take_along_axis(near, few, 1), axis=1, kind="stable"), 1)


def ordered(rows: DataFrame, of: np.ndarray, depth: int) -> DataFrame:
    """rows (.., v) with `order`, the nearest pivots of v, null where v is of another length."""
    schema = T.StructType([*rows.schema.fields, T.StructField("order", T.ArrayType(T.ShortType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "v"):
            v = A.column(batch, "v")
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            fits = sizes == of.shape[1]
            out = np.zeros((int(fits.sum()), min(depth, of.shape[0])), np.int16)
            if len(out):
                x = v.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(out), -1)
                out = orders(x, of, depth).astype(np.int16)
            ends = np.concatenate([[0], np.cumsum(np.where(fits, out.shape[1], 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(~fits))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "order"])

    return rows.mapInArrow(run, schema)


def search_block(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray, k: int, share: float, floor: int, mine: np.ndarray | None = None, theirs: np.ndarray | None = None, places: np.ndarray | None = None, posted: int = POSTED) -> Iterator[tuple]:
    """(query, ids, scores) of the best k of a block for each query. mine, theirs: orders of the block's vectors and of the
    queries; places: where in its order each query has the pivot of this file. Without orders all are scored."""
    if mine is not None:
        depth = mine.shape[1]
        flat = mine.ravel().astype(np.int64)
        by = np.argsort(flat, kind="stable")
        bounds = np.searchsorted(flat[by], np.arange(flat.max(initial=0) + 2))
        owner, rank = by // depth, (by % depth).astype(np.int16)
    for n, query in enumerate(queries):
        chosen = np.arange(len(ids))
        if mine is not None:
            # A shared pivot saves, of the footrule, the two ranks' distances to the end less their difference.
            saved = np.zeros(len(ids), np.int32)
            open_ = np.ones(len(ids), bool)
            for r, p in enumerate(theirs[n].tolist()):
                if p + 1 >= len(bounds):
                    continue
                a, b = bounds[p], bounds[p + 1]
                there, who = rank[a:b], owner[a:b]
                saved[who] += 2 * (depth - np.maximum(there, r)).astype(np.int32)
                if r < places[n]:
                    open_[who[there < posted]] = False
            chosen = np.flatnonzero(open_)
            count = max(floor, int(len(chosen) * share), 2 * k)
            if count < len(chosen):
                own = saved[chosen]
                line = np.partition(own, len(own) - count)[len(own) - count]
                chosen = chosen[own >= min(line, int(CLOSE * depth * (depth + 1)))]
        chosen = chosen[ids[chosen] != query]
        score = (x[chosen] * q[n]).sum(axis=1)
        best = np.lexsort((ids[chosen], -score))[:k]
        yield query, ids[chosen[best]], score[best]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, share: float = SHARE, floor: int = FLOOR, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK, n_pivots: int = PIVOTS, posted: int = POSTED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of vectors (vec_id, embedding) where
    `queries` holds."""
    rows = vectors.where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select(
        "vec_id", F.col("embedding").alias("v"), F.coalesce(queries, F.lit(False)).alias("query"))
    rows = rows.groupBy("vec_id", "v").agg(F.max("query").alias("query"))
    least = Window.partitionBy("v").orderBy("vec_id")
    index = rows.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1).select("vec_id", "v")
    index = written(index, "vectors")
    of = pivots(index.select(F.col("v").cast("array<double>").alias("v")), n_pivots)
    asked = ordered(index.withColumn("query", F.lit(False)).unionByName(rows.where("query")), of, ORDER)
    posts = written(asked, "posts")
    discard(index)
    first = F.slice("order", 1, posted)
    files = posts.select("vec_id", "v", "order", "query", F.size("v").alias("n"), F.posexplode(F.coalesce(first, F.array(F.lit(-1).cast("smallint")))).alias("place", "pivot"))
    sizes = written(
        files.groupBy("n", "pivot").agg(F.ceil(F.count_if(~F.col("query")) / index_block).cast("int").alias("right"), F.ceil(F.count_if("query") / query_block).cast("int").alias("left"))
        .where("left > 0 and right > 0"), "sizes")
    own, every = F.xxhash64("vec_id", "v"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = files.join(sizes, ["n", "pivot"])
    rest = ["n", "pivot", "vec_id", "v", "order", "query", "place"]
    held = dealt.where(~F.col("query")).select(*rest, F.pmod(own, "right").cast("int").alias("i"), every("left").alias("j"))
    asks = dealt.where("query").select(*rest, F.pmod(own, "left").cast("int").alias("j"), every("right").alias("i"))

    def run(group: pa.Table) -> pa.Table:
        asking = np.array(group.column("query").to_pylist(), bool)
        found = []
        if asking.any() and not asking.all():
            ids = group.column("vec_id").to_numpy()
            x = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            ranked: tuple = ()
            if group.column("pivot")[0].as_py() >= 0:
                order = group.column("order").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                ranked = (order[~asking], order[asking], group.column("place").to_numpy()[asking], posted)
            found = list(search_block(ids[~asking], x[~asking], ids[asking], x[asking], k, share, floor, *ranked))
        return pa.table({
            "query_id": pa.array(np.concatenate([np.full(len(i), q) for q, i, _ in found]) if found else [], pa.int64()),
            "vec_id": pa.array(np.concatenate([i for _, i, _ in found]) if found else [], pa.int64()),
            "score": pa.array(np.concatenate([s for _, _, s in found]) if found else [], pa.float64()),
        })

    met = held.unionByName(asks).groupBy("n", "pivot", "i", "j").applyInArrow(run, RESULT).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
