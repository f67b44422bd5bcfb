"""Exact top-k search against scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import topk_search

SCHEMA = "vec_id long, embedding array<double>"


def plain(data, k=5, every=50):
    sound = []
    for i, v in data:
        if v and all(c is not None and math.isfinite(c) for c in v):
            x = [math.floor(256 * c) if abs(c) < 1e30 else 1 << 62 for c in v]
            if sum(c * c for c in x) < 1 << 62:
                sound.append((i, x))
    out = []
    for i, x in sound:
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y)), j is None, j or 0) for j, y in sound
                           if j != i and len(x) == len(y))
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def result(spark, data, **more):
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    for c in ("id", "pos", "rng", "score", "x"):        # names that the operator uses itself
        df = df.withColumn(c, F.lit(7))
    return sorted((tuple(r) for r in topk_search.top_k(df, F.col("id") % 50 == 0, **more).collect()), key=repr)


def test_hostile_table(spark):
    rng = random.Random(1)
    vec = lambda d=8, s=1.0: [rng.gauss(0, s) for _ in range(d)]     # noqa: E731
    data = [(i, vec()) for i in range(300)] + [(1000 + i, vec(3)) for i in range(40)]
    same = vec()
    data += [(400 + i, same) for i in range(120)]                   # copies: ties by id
    data += [(550, None), (600, []), (650, [None] * 8), (700, [math.nan] * 8), (750, [math.inf] * 8), (800, [0.0] * 8),
             (850, [1e300] * 8), (900, vec(8, 1e6)), (950, vec(8, 1e6)), (None, vec()), (None, same), (2050, vec(5)),
             (100, vec()), (100, vec()), (-50, vec())]
    assert result(spark, data) == plain(data)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_pruning_loses_nothing(spark, spread):
    """Equal and unequal lengths, clusters, more ranges and blocks than one."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2500, 16)) * np.linspace(2, 0.2, 16) + rng.standard_normal((5, 16))[rng.integers(0, 5, 2500)]
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(spread * rng.standard_normal((2500, 1)))
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    assert result(spark, data) == plain(data)


def test_blocks_of_one_query_and_ranges_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "RANGE_VALUES", 64)
    monkeypatch.setattr(topk_search, "BLOCK_VALUES", 16)
    rng = random.Random(3)
    data = [(i * 10, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)]
    assert result(spark, data) == plain(data)
    assert result(spark, data, k=100) == plain(data, k=100)


def test_rest_is_searched_less(monkeypatch):
    """With falling lengths the search ends early, and results stay."""
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((5000, 8)) * np.geomspace(1000, 1, 5000)[:, None]).astype(np.int64)
    q = x[:40]
    seen = []
    slabs = topk_search._slabs
    monkeypatch.setattr(topk_search, "_slabs", lambda n: (seen.append(s) or s for s in slabs(n)))
    ids, none = np.arange(5000), np.full(40, -np.inf)
    i, j, s = topk_search.search(x, ids, np.ones(5000, bool), q, ids[:40], none, 5)
    assert sorted(zip(i, j, s)) == [(a, *r) for a in range(40) for r in sorted(
        sorted(((b, int(q[a] @ x[b])) for b in range(5000) if b != a), key=lambda t: (-t[1], t[0]))[:5])]
    assert seen[-1][1] < 5000


def test_empty_table(spark):
    assert topk_search.top_k(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0).collect() == []
