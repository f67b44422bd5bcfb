"""Blocks of documents return a share of a query's best rows, and nothing is lost."""

import random

import pyarrow as pa
import pytest

from quarry.operators import index as ix
from quarry.operators import rerank as rr
from quarry.operators import retrieve as rt
from quarry.operators.util import top_k
from quarry.session import scratch_path


@pytest.fixture(scope="module")
def asked(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=rnd.choice([2, 9, 30]))), " ".join(rnd.choices(words, k=2)))
                                  for i in range(300)] + [(None, "w1 w2", ""), (7, "w1", "w3"), (301, None, None)],
                                 "docno long, text string, keywords string")
    two = ix.build_index(docs, scratch_path(spark, "share"), fields=("text", "keywords"), doc_buckets=2, term_buckets=4,
                         stop_words=None)
    topics = spark.createDataFrame([(i, f"w{i % 40} w{(7 * i) % 40} w{i % 40}") for i in range(50)] + [(None, "w5 w6")],
                                   "qid long, query string")
    return two, rt.query_terms(topics, two)


@pytest.mark.parametrize("share", [None, 2])
def test_blocks_return_a_share_and_nothing_is_lost(asked, monkeypatch, share):
    """With shares too small for some queries, these are asked again."""
    two, qt = asked
    best = lambda df: sorted((r.qid or -1, r.rank, r.docno or -1, round(r.score, 5)) for r in df.collect())     # noqa: E731
    for make in (lambda k: rt.bm25(two, qt, k), lambda k: rt.tf_idf(two, qt, k, b=0.3), lambda k: rt.bm25f(two, qt, (0.7, 0.3), k)):
        whole = [r for r in best(make(None)) if r[1] <= 20]
        rows = []
        with monkeypatch.context() as m:
            m.setattr(rt, "BLOCK_DOCS", 10)                      # 31 blocks
            m.setattr(rt, "FEW_ROWS", 0)
            m.setattr(rt, "top_k", lambda df, *a, **kw: rows.append(df.count()) or top_k(df, *a, **kw))
            if share:
                m.setattr(rt, "block_share", lambda k, blocks: share)
            assert best(make(20)) == whole
        assert rows[0] <= 51 * 31 * (share or rt.block_share(20, 31))
        assert len(rows) == (2 if share else 1)


def test_share_of_a_block():
    assert rt.block_share(100, 1) == 100 and rt.block_share(100, 32) < 20 and rt.block_share(2, 64) == 2


def test_a_run_is_written_once(asked, monkeypatch):
    """What the blocks found is a stored table: steps that need it again read it, and do not score again."""
    two, qt = asked
    monkeypatch.setattr(rt, "BLOCK_DOCS", 10)
    monkeypatch.setattr(rt, "FEW_ROWS", 0)
    run = rt.bm25(two, qt, 20)
    from quarry.operators.util import stored
    assert stored(run, "run") is run and "postings" not in run._jdf.queryExecution().optimizedPlan().toString()


def test_terms_of_passages_in_one_string(monkeypatch):
    passages = {"docno": pa.array([2, 1, 1, 2], pa.int64()), "passage_no": pa.array([1, 0, 1, 0], pa.int32()),
                "same": pa.array([21, 10, 11, 20], pa.int64())}
    wanted = {"qid": pa.array([7, 8, 9], pa.int64()), "docnos": pa.array([[1, 2], [2, 9], [1]], pa.list_(pa.int64())),
              "idfs": pa.array([[1.0, 3.0], [2.0], None], pa.list_(pa.float64())), "total": [4.0, 2.0, 0.0]}
    monkeypatch.setattr(rr, "PASSAGES", 3)
    got = rr._best_passages(pa.table({**passages, "terms": ["x y", "x", "x z", ""]}),
                            pa.table({**wanted, "terms": pa.array(["x y", "z", None])}))
    assert [tuple(r.values()) for r in got.to_pylist()] == [(7, 1, 0.25, 0, 10), (7, 2, 1.0, 1, 21), (8, 2, 0.0, 0, 20), (9, 1, 0.0, 0, 10)]
