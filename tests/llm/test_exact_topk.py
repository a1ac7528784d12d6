"""Exact top-k against all pairs in Python's whole numbers, in blocks and whole, and odd tables."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import exact_topk


def brute(rows, every, k):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        found = collections.defaultdict(lambda: -(10**400))
        for i, own in rows:
            if i == q:
                for j, v in rows:
                    if j != q:
                        found[j] = max(found[j], sum(a * b for a, b in zip(own, v)))
        held = {j: min(max(s, exact_topk.LEAST), exact_topk.MOST) for j, s in found.items()}
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted((-s, j) for j, s in held.items())[:k])]
    return out


def asked(df, every=50, **more):
    return sorted(tuple(r) for r in exact_topk.nearest(df, F.col("vec_id") % every == 0, **more).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("blocks", [{}, {"block": 70, "query_block": 4}])
def test_against_all_pairs(spark, blocks):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.0, rng.gauss(0, 1)]) for _ in range(12)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(150)]  # a crowd of one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert asked(df, **blocks) == brute(rows, 50, 5)
    assert asked(df, k=600, **blocks) == brute(rows, 50, 600)


def test_selection_without_the_whole_block(monkeypatch, spark):
    monkeypatch.setattr(exact_topk, "CELLS", 100)
    rng = random.Random(4)
    rows = [(i, [rng.random() - 0.5 for _ in range(8)]) for i in range(90)]
    assert asked(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=3, k=4) == brute(rows, 3, 4)


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (0, [-1.0]), (50, []), (1, [0.0, 0.0]), (2, [2.0, -3.0, 4.0]), (2, [2.0, 9.0]), (100, [0.001, -0.001]), (3, [-5.0])]
    odd = [(None, [1.0]), (150, None), (4, [nan]), (5, [None, 1.0]), (200, [inf]), (6, [-inf, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<double>, v int, query int")
    assert asked(df) == brute(rows, 50, 5)
    assert asked(df.limit(0)) == []
    assert exact_topk.nearest(df, F.lit(None).cast("boolean")).count() == 0
    assert asked(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")) == []


def test_values_beyond_64_bits(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0]), (3, [0.0, 2.0]), (50, [1e9, 1e9]), (51, [1e8, 3.0])]
    assert asked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows, 50, 5)


def test_floats_are_quantised_as_doubles(spark):
    rows = [(0, [0.1, -0.1]), (1, [0.99609375, 0.2]), (2, [1 / 256, -1 / 256])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert asked(df) == brute(exact, 50, 5)
