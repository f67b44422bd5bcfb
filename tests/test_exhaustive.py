"""Exhaustive dense search: blocks, ties, repeated and missing ids, what is no number."""

import numpy as np
import pytest

from quarry.operators import dense as de


def brute(docs, queries, k):
    """By falling rounded score, then id (null first); queries of one id count as one."""
    out = []
    for qid in dict.fromkeys(q for q, _ in queries):
        rows = [(-round(float(np.dot(np.float64(v), np.float64(w))), 6) + 0.0, d is not None, d or 0)
                for q, v in queries if q == qid for d, w in docs]
        out += [(-1 if qid is None else qid, i + 1, d if known else -1, round(-s, 5) + 0.0) for i, (s, known, d) in enumerate(sorted(rows)[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(1 << 20, 8192, 2048, 512), (1 << 20, 20, 16, 7), (70, 1000, 16, 7), (70, 20, 9, 3)])
def test_search_against_brute_force(spark, monkeypatch, sizes):
    for name, n in zip(("DOC_BLOCK", "QUERY_BLOCK", "BLOCK_ROWS", "BLOCK_QUERIES"), sizes):
        monkeypatch.setattr(de, name, n)
    rnd = np.random.default_rng(5)
    vec = lambda: [float(x) for x in rnd.integers(-3, 4, 4) / 2]                           # noqa: E731  many ties
    docs = [(i, vec()) for i in range(200)] + [(7, vec()), (None, vec())]
    queries = [(i, vec()) for i in range(60)] + [(3, vec()), (None, vec())]
    d = spark.createDataFrame(docs + [(999, None)], "docno int, vec array<float>")
    q = spark.createDataFrame(queries + [(999, None)], "qid long, vec array<double>")
    for k in (1, 10, 300):
        got = de.exhaustive_topk(d, q, k).collect()
        rows = sorted((-1 if r.qid is None else r.qid, r.rank, -1 if r.docno is None else r.docno, round(r.score, 5) + 0.0) for r in got)
        assert rows == brute(docs, queries, k)


def test_many_queries_rank_in_their_task(spark, monkeypatch):
    """Each query meets all documents in one task: no rows of partial results travel."""
    monkeypatch.setattr(de, "BLOCK_QUERIES", 8)
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(100)], "docno int, vec array<float>")
    run = de.exhaustive_topk(v, v.withColumnRenamed("docno", "qid"), 5)
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    assert run.count() == 500


def test_no_numbers_come_last_into_a_block_and_first_in_rank():
    best = de._Best(np.array([[1.0], [-1.0]]), 3)
    for at, x in enumerate([np.nan, 2.0, np.nan, np.inf, 2.0, 5.0]):
        best.meet(np.array([[x]]), at)
    s, p = best.ranked()
    assert p.tolist() == [[3, 5, 1], [1, 4, 5]] and s[0].tolist() == [np.inf, 5.0, 2.0]
    few = de._Best(np.array([[1.0]]), 9)
    few.meet(np.array([[1.0], [np.nan], [3.0]]), 0)
    assert few.ranked()[1].tolist() == [[1, 2, 0]]
