"""The permutation index against brute force: with files in blocks and a share that cuts, and odd tables."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import permutation_index


def brute(rows, asks, k):
    out = {}
    for q in asks:
        best = {}
        for i, own in rows:
            for j, v in rows:
                if i == q and j != q and len(v) == len(own):
                    best[j] = max(best.get(j, -np.inf), float((np.array(own) * np.array(v)).sum()))
        out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def asked(df, **more):
    got = collections.defaultdict(list)
    for r in permutation_index.nearest(df, F.col("vec_id") % 20 == 0, k=10, **more).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("blocks", [(16_384, 4_096), (90, 3)])
def test_recall_where_the_index_cuts(spark, blocks):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 24))
    x = (centres[rng.integers(0, 40, 3000)] + 0.7 * rng.normal(size=(3000, 24))).astype(np.float32)
    x[100:900] = x[100]  # a crowd of one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = asked(df, share=0.2, floor=12, n_pivots=64, posted=8, index_block=blocks[0], query_block=blocks[1])
    y = x.astype(np.float64)
    hits = 0
    for q in range(0, 3000, 20):
        score = (y * y[q]).sum(axis=1)
        score[q] = -np.inf
        want = np.lexsort((np.arange(3000), -score))[:10]
        hits += len({v for v, _ in got[q]} & set(want.tolist()))
        assert all(s == score[v] for v, s in got[q])
    assert hits >= 0.9 * 10 * 150


def test_files_are_not_searched_whole():
    """A query ranks what stands in the file, leaves out what an earlier file had, and scores a share of the rest."""
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(500, 16)), rng.normal(size=(1, 16))
    of = x[:32] / np.linalg.norm(x[:32], axis=1, keepdims=True)
    mine, theirs = permutation_index.orders(x, of, 16), permutation_index.orders(q, of, 16)
    ids = np.arange(500)
    own = {}
    for place in (0, 3):
        inside = np.flatnonzero((mine[:, :8] == theirs[0, place]).any(axis=1))
        (_, found, _), = permutation_index.search_block(ids[inside], x[inside], np.array([-1]), q, 500, 0.1, 5, mine[inside], theirs, np.array([place]), 8)
        own[place] = set(found.tolist())
        before = {i for i in inside.tolist() if set(mine[i, :8]) & set(theirs[0, :place])}
        assert own[place] == set(inside.tolist()) - before
    assert not own[0] & own[3]
    inside = np.flatnonzero((mine[:, :8] == theirs[0, 0]).any(axis=1))
    (_, found, _), = permutation_index.search_block(ids[inside], x[inside], np.array([-1]), q, 2, 0.1, 5, mine[inside], theirs, np.array([0]), 8)
    assert len(found) == 2


def test_odd_tables(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0]), (40, [1.0, 2.0, 3.0]), (5, [3.0, 2.0, 1.0]), (60, [1.0] * 5)]
    odd = [(None, [1.0, 1.0]), (6, None), (7, [0.0, 0.0]), (80, [float("nan"), 1.0]), (8, [None, 1.0])]
    df = spark.createDataFrame([(*r, "v", 1) for r in rows + odd], "vec_id long, embedding array<double>, v string, query int")
    got = asked(df)
    want = brute(rows, [0, 20, 40, 60], 10)
    assert dict(got) == {q: w for q, w in want.items() if w}
    assert permutation_index.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert permutation_index.nearest(df, F.lit(False)).count() == 0
