import numpy as np
import pandas as pd
import pytest

from quarry.operators import analysis as an
from quarry.operators import collection as co
from quarry.operators import index as ix
from quarry.plans import experiments as xp
from quarry.sources import runs as runs_io

VALUES = [0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 100]


def test_histogram_matches_numpy(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "x int")
    h = an.histogram(df, "x", 50).orderBy("bin").collect()
    counts, edges = np.histogram(VALUES, bins=50)
    assert [r["count"] for r in h] == counts.tolist()
    assert [r.lo for r in h] == pytest.approx(edges[:-1].tolist())
    c = an.cumulative(df, "x", 100).orderBy("bin").collect()
    cn, _ = np.histogram(VALUES, bins=100)
    assert [r.cum_pct for r in c] == pytest.approx((np.cumsum(cn) * 100.0 / len(VALUES)).round(6).tolist())


def test_describe_matches_pandas(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "x int")
    r = an.describe(df, "x").first()
    d = pd.Series(VALUES).describe()
    assert r["count"] == d["count"]
    for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                         ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert r[ours] == pytest.approx(round(d[theirs], 6))


def test_fraction_and_lengths(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None)], "docno int, text string")
    lens = {r.docno: (r.n_words, r.n_tokens) for r in an.with_lengths(docs).collect()}
    assert lens == {1: (3, 3), 2: (0, 0), 3: (0, 0)}
    assert an.fraction_within(an.with_lengths(docs), "n_words", 0).first().fraction == round(2 / 3, 6)
    m = an.max_lengths(docs).first()
    assert (m.max_docno_len, m.max_text_len) == (1, 5)


def test_summary(spark):
    df = spark.range(10).withColumnRenamed("id", "docno")
    rows = co.summary(df, "docno", 3).collect()
    assert [r.docno for r in rows] == [0, 1, 2] and all(r.n_rows == 10 for r in rows)


def test_run_save_and_reuse(spark, scratch):
    run = spark.createDataFrame([(1, 10, 1.5, 1), (1, 11, 0.25, 2)], "qid long, docno long, score double, rank int")
    path = scratch("runs") + "/sys"
    calls = []

    def compute():
        calls.append(1)
        return run
    a = runs_io.reuse(spark, path, compute, "sys", "bigint", "bigint").collect()
    b = runs_io.reuse(spark, path, compute, "sys", "bigint", "bigint").collect()
    assert len(calls) == 1 and sorted(a) == sorted(b)
    assert sorted((r.qid, r.docno, r.rank, r.score) for r in a) == [(1, 10, 1, 1.5), (1, 11, 2, 0.25)]
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert lines[0] == "1 Q0 10 1 1.5 sys"


def test_sample_naming_and_reuse(spark, scratch):
    docs = spark.createDataFrame([(i, f"w{i} common word{i % 3}") for i in range(30)], "docno long, text string")
    idx = ix.build_index(docs, scratch("x-idx"), doc_buckets=2)
    topics = spark.createDataFrame([(i, f"w{i} word{i % 3}") for i in range(12)], "qid long, query string")
    qrels = spark.createDataFrame([(i, i, 0, 1) for i in range(12)], "qid long, docno long, iteration int, relevance int")
    save = scratch("x-runs")
    t1 = xp.experiment_1(idx, topics, qrels, sample=5, save_dir=save)
    names = sorted(r.name for r in t1.collect())
    assert names == sorted(f"experiment1_{s}_sample_5_queries" for s in ("bm25", "bm25_rm3", "tfidf", "tfidf_rm3"))
    again = xp.experiment_1(idx, topics, qrels, sample=5, save_dir=save)
    assert sorted(tuple(r) for r in t1.collect()) == sorted(tuple(r) for r in again.collect())
    full = {r.name: r for r in xp.experiment_1(idx, topics, qrels).collect()}
    assert full["experiment1_bm25"].p_1 == 1.0


def test_fielded_index_stats(spark, scratch):
    docs = spark.createDataFrame([(1, "alpha beta", "gamma"), (2, "beta", "")], "docno long, text string, keywords string")
    idx = ix.build_index(docs, scratch("f-idx"), fields=("text", "keywords"), doc_buckets=2)
    assert idx.fields == ("text", "keywords") and idx.field_tokens == (3, 1) and idx.n_docs == 2
    assert idx.avgdl(0) == 1.5 and idx.avgdl(1) == 0.5
    lex = {r.term: r.df for r in ix.lexicon(idx).collect()}
    assert lex == {"alpha": 1, "beta": 2, "gamma": 1}
    st = {r.field_name: r.avgdl for r in idx.stats().collect()}
    assert st == {"text": 1.5, "keywords": 0.5}


def test_runs_of_other_topics_are_not_reused(spark, scratch):
    docs = spark.createDataFrame([(i, f"w{i} common") for i in range(12)], "docno long, text string")
    idx = ix.build_index(docs, scratch("y-idx"), doc_buckets=2)
    qrels = spark.createDataFrame([(i, i, 0, 1) for i in range(4)], "qid long, docno long, iteration int, relevance int")
    right = spark.createDataFrame([(i, f"w{i}") for i in range(4)], "qid long, query string")
    wrong = spark.createDataFrame([(i, f"w{i + 5}") for i in range(4)], "qid long, query string")
    save = scratch("y-runs")
    one = {r.name: r.map for r in xp.experiment_1(idx, right, qrels, save_dir=save).collect()}
    two = {r.name: r.map for r in xp.experiment_1(idx, wrong, qrels, save_dir=save).collect()}
    assert one["experiment1_bm25"] == 1.0 and two["experiment1_bm25"] == 0.0


def test_system_without_results_keeps_its_row(spark, scratch):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta")], "docno long, text string")
    idx = ix.build_index(docs, scratch("z-idx"), doc_buckets=2)
    topics = spark.createDataFrame([(1, "nothing")], "qid long, query string")
    qrels = spark.createDataFrame([(1, 1, 0, 1)], "qid long, docno long, iteration int, relevance int")
    got = xp.experiment_1(idx, topics, qrels).collect()
    assert len(got) == 4 and all(r.map == 0.0 and r.p_1 == 0.0 for r in got)


def test_run_ids_with_spaces_are_refused(spark, scratch):
    run = spark.createDataFrame([("a b", 1, 1.0, 1)], "qid string, docno long, score double, rank int")
    with pytest.raises(Exception, match="not a word"):
        runs_io.save_run(run, scratch("bad"), "sys")
