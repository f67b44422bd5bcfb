"""Whitening against exact integer covariances on small tables."""

import math
import random
from fractions import Fraction

import numpy as np
from conftest import SF_SMALL
from pyspark.sql import functions as F

from quarry.llm import whitening
from quarry.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<double>"


def fixed(v):
    return tuple(math.floor(64 * c) + 1_000_000 for c in v)


def model(vectors):
    """``(n, S, covariance)`` of the distinct vectors, by products of centred values."""
    fit = sorted(set(vectors))
    n, dim = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(dim)]
    c = [[n * x[i] - s[i] for i in range(dim)] for x in fit]
    cov = [[Fraction(sum(r[i] * r[j] for r in c), n ** 3) for j in range(dim)] for i in range(dim)]
    return n, s, np.array([[float(v) for v in r] for r in cov])


def check(data, got):
    """Rows of one dimension: data ``(id, vector)``, got as returned."""
    xs = [(i, fixed(v)) for i, v in data]
    n, s, cov = model([x for _, x in xs])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    rows = {}
    for r in got:
        rows.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(xs) * len(e)
    for k in range(len(e)):
        mine = [rows[i][k + 1] for i, _ in xs]
        assert {r.n for r in mine} == {n}
        assert [r.deviation for r in mine] == [sum((n * a - b) ** 2 for a, b in zip(x, s)) for _, x in xs]
        if e[k] <= 1e-11 * max(np.trace(cov), 1e-300):
            assert all(r.whitened is None and r.explained == 0 for r in mine)
            continue
        want = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(x, s)] for _, x in xs]) @ u[:, k] / math.sqrt(e[k])
        have = np.array([r.whitened for r in mine])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
        assert all(abs(r.explained - e[k] / np.trace(cov)) <= 1e-4 * r.explained for r in mine)
        assert all(r.identity_error <= 1e-4 for r in mine)


def result(spark, data):
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    for c in ("id", "x", "n", "v", "digits"):
        df = df.withColumn(c, F.lit(7))
    return whitening.whiten(df).collect()


def test_covariance_and_projection(spark):
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 3 / (1 + j)) + rng.random() * j for j in range(20)]) for i in range(200)]
    data += [(1000 + i, data[5][1]) for i in range(80)]            # copies count once in the fit
    check(data, result(spark, data))


def test_large_and_constant_components(spark):
    """Values whose squares pass 2**63, a dimension without variance, fewer vectors than dimensions."""
    rng = random.Random(2)
    data = [(i, [rng.gauss(0, 1e7), rng.gauss(0, 2e6), 5.0]) for i in range(60)]
    got = result(spark, data)
    assert len(got) == 180 and {r.identity_error for r in got if r.component < 3} != {None}
    n, s, cov = model([fixed(v) for _, v in data])
    df = spark.createDataFrame([(list(fixed(v)),) for _, v in data], "x array<long>")
    assert whitening.sums(df, 3) == s
    assert np.array_equal(whitening.covariance(df, 3, n, s), cov)
    assert all(r.whitened is None for r in got if r.component == 3)
    few = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(4)]
    check(few, result(spark, few))


def test_exact_square_sums():
    rng = random.Random(3)
    for bits in (10, 31, 40, 45, 60):
        d = np.array([[rng.randrange(-(1 << bits), 1 << bits) for _ in range(7)] for _ in range(50)], np.int64)
        want = [sum(int(v) ** 2 for v in d[:, j]) for j in range(7)]
        assert whitening.square_sums(d, 0) == want
        assert whitening._number(whitening._digits(want[0])) == want[0]
    assert whitening._number(whitening._digits(-10 ** 50 - 7)) == -10 ** 50 - 7


def test_hostile_rows(spark):
    rng = random.Random(4)
    good = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)] + [(None, [1.0, 2.0, 3.0, 4.0]), (7, [0.5] * 4)]
    other = [(100 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(10)]
    bad = [(200, None), (201, []), (202, [None] * 4), (203, [math.nan, 1.0, 1.0, 1.0]), (204, [math.inf] * 4), (205, [1e300] * 4)]
    got = result(spark, good + other + bad)
    assert len(got) == 4 * len(good) + 3 * len(other)
    check(other, [r for r in got if r.vec_id is not None and 100 <= r.vec_id < 200])
    assert {r.n for r in got if r.vec_id is None or r.vec_id < 100} == {32}


def test_single_vector_and_empty_table(spark):
    got = result(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, 0.0, None)] * 4
    assert result(spark, [(1, None)]) == []


def test_query(spark):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    check(data, op13_whitening(spark, SF_SMALL).collect())
