"""Pruned retrieval gives what whole retrieval gives, and reads less."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import index as ix
from quarry.operators import retrieve as rt
from quarry.session import scratch_path


def corpus(spark, n=400, seed=1):
    """Zipf words: ``w0`` stands in most documents (negative BM25 weight), rare words in few."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    rows = [(i, " ".join(rnd.choices(words, weights, k=rnd.choice([3, 8, 20, 60]))), " ".join(rnd.choices(words, k=3)))
            for i in range(n)]
    return spark.createDataFrame([*rows, (n, "", ""), (n + 1, None, "w5")], "docno long, text string, keywords string")


@pytest.fixture(scope="module")
def index(spark):
    return ix.build_index(corpus(spark), scratch_path(spark, "prune"), doc_buckets=2, term_buckets=8, stop_words=None)


def rows(df):
    return sorted((r.qid, r.rank, r.docno, round(r.score, 5)) for r in df.collect())


TOPICS = ["w0", "w3", "w90 w90 w2", "w0 w1 w2 w3", "w40 w7 w0 w0", "w110", "w5 w6 w7 w8 w9 w10", "nothing", "w1 w119"]


@pytest.mark.parametrize("k", [1, 5, 40])
def test_pruned_equals_whole(spark, index, k):
    topics = spark.createDataFrame(list(enumerate(TOPICS)), "qid long, query string")
    many = spark.createDataFrame([(100 + i, f"w{i % 9} w{i} w{i} w{(7 * i) % 120}") for i in range(60)], "qid long, query string")
    for t in (topics, many):                # literals in the scan, and a filter behind the join
        qt = rt.query_terms(t, index)
        for model in rt.MODELS:
            whole = [r for r in rows(rt.retrieve(index, qt, model, None)) if r[1] <= k]
            assert rows(rt.retrieve(index, qt, model, k)) == whole
    weighted = spark.createDataFrame([(1, "w1", 0.3), (1, "w60", 2.0), (1, "w4", -1.5)], "qid int, term string, weight double")
    assert rows(rt.bm25(index, weighted, k)) == [r for r in rows(rt.bm25(index, weighted, None)) if r[1] <= k]


@pytest.mark.parametrize("k", [1, 10])
def test_fields_pruned_equals_whole(spark, k):
    idx = ix.build_index(corpus(spark), scratch_path(spark, "prune2"), fields=("text", "keywords"), doc_buckets=2,
                         term_buckets=4, stop_words=None)
    qt = rt.query_terms(spark.createDataFrame(list(enumerate(TOPICS)), "qid long, query string"), idx)
    for weights in ((0.7, 0.3), (0.0, 1.0), (1.0, 0.0)):
        assert rows(rt.bm25f(idx, qt, weights, k)) == [r for r in rows(rt.bm25f(idx, qt, weights, None)) if r[1] <= k]


def test_least_impacts_act(spark, index):
    """One rare and one common word: most postings of the common one are below its least impact."""
    qt = rt.query_terms(spark.createDataFrame([(1, "w100 w100 w100 w100 w9")], "qid long, query string"), index)
    b = rt._touched(index, qt)
    floored = rt._floored(rt._weighted_terms(index, qt, "BM25", b), 1, 2.2, 1.2, {0: 1.0})
    least = {r.term: r.least for r in floored.collect()}
    assert least["w100"] > 0
    kept = rt._matched(index, floored, qt, b, 0).filter("term = 'w100'").count()
    assert kept < index.postings.filter("term = 'w100'").count()


def test_scan_reads_touched_buckets_only(spark, index):
    qt = rt.query_terms(spark.createDataFrame([(1, "w3 w4")], "qid long, query string"), index)
    plan = rt.bm25(index, qt, 10)._jdf.queryExecution().executedPlan().toString()
    buckets = sorted(r.b for r in qt.select(ix.term_bucket("term", 8).alias("b")).distinct().collect())
    paths = [line for line in plan.splitlines() if "postings" in line and "FileScan" in line]
    assert len(paths) == 1 and f"InMemoryFileIndex({len(buckets)} paths)" in paths[0].replace("path)", "paths)")
    assert "GreaterThanOrEqual(ntf" in paths[0] or "EqualTo(term" in paths[0]


def test_feedback_reads_no_postings(spark, index):
    qt = rt.query_terms(spark.createDataFrame([(1, "w3 w4")], "qid long, query string"), index)
    run = spark.createDataFrame([(1, 5, 2.0, 1), (1, 6, 1.0, 2)], "qid long, docno long, score double, rank int")
    plan = rt.rm3_terms(index, run, qt)._jdf.queryExecution().executedPlan().toString()
    assert "_postings" not in plan and "_forward" in plan
    assert "SelectedBucketsCount" in plan          # the literals of two documents prune buckets


def test_forward_table_is_the_postings(spark, index):
    forward = index.forward.select("docno", "field", "dl", F.inline("terms")).select("docno", "field", "term", "dl", "tf")
    assert sorted(map(tuple, forward.collect())) == sorted(map(tuple, index.postings.select(*forward.columns).collect()))
    assert index.doc_stats.count() == 402


def test_experiment_reads_postings_once_a_run(spark, index, monkeypatch):
    """Plain runs are made once and feed RM3 and the metrics: four retrievals for four systems."""
    from quarry.plans import experiments as xp
    topics = spark.createDataFrame([(1, "w3 w4"), (2, "w50")], "qid long, query string")
    qrels = spark.createDataFrame([(1, 5, 0, 1), (2, 9, 0, 1)], "qid long, docno long, iteration int, relevance int")
    asked = []
    real = rt.retrieve
    monkeypatch.setattr(rt, "retrieve", lambda *a, **k: asked.append(1) or real(*a, **k))
    out = xp.experiment_1(index, topics, qrels)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(asked) == 4 and "_postings" not in plan
    assert out.count() == 4


def test_many_terms_are_answered_by_blocks(spark, index, monkeypatch):
    """Pairs of a query and a matching document are no rows; several blocks of queries and documents, ties, null ids."""
    monkeypatch.setattr(rt, "BLOCK_DOCS", 90)
    monkeypatch.setattr(rt, "BLOCK_TERMS", 60)
    many = spark.createDataFrame([(i, f"w{i % 9} w{i} w{i} w{(7 * i) % 120}") for i in range(60)], "qid long, query string")
    docs = corpus(spark).unionByName(spark.createDataFrame([(None, "w1 w2", "w3"), (5, "w1", "w2")], "docno long, text string, keywords string"))
    two = ix.build_index(docs, scratch_path(spark, "blocks"), fields=("text", "keywords"), doc_buckets=2, term_buckets=4, stop_words=None)
    qt = rt.query_terms(many, two)
    best = lambda df, k: sorted(r for r in ((r.qid, r.rank, r.docno or -1, round(r.score, 5)) for r in df.collect()) if r[1] <= k)
    for make in (lambda k: rt.bm25(two, qt, k), lambda k: rt.tf_idf(two, qt, k, b=0.3), lambda k: rt.bm25f(two, qt, (0.7, 0.3), k),
                 lambda k: rt.bm25f(two, qt, (0.0, 1.0), k)):
        assert best(make(7), 7) == best(make(None), 7)
    assert "FlatMapCoGroupsInArrow" in rt.bm25(two, qt, 7)._jdf.queryExecution().executedPlan().toString()
