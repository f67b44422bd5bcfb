"""Steps that must not grow with the wrong thing: plans, merges, batches, models."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import analysis as an
from quarry.operators import answer as an_
from quarry.operators import index as ix
from quarry.operators import keywords as kw
from quarry.operators.models import worker_model
from quarry.operators.util import rank_window, stored, top_k
from quarry.session import scratch_path
from quarry.sources import tables, thesaurus

SF = "/root/testdata/sf0.001"


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("Initial Plan")[0]


def test_top_k_merges_in_two_levels(spark):
    """400 partitions, one query: 20 slices pass on 5 rows each, not 400 partitions."""
    df = spark.range(8000, numPartitions=16).select(
        F.lit("q").alias("qid"), F.col("id").alias("docno"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("score"))
    plain = df.withColumn("rank", F.row_number().over(rank_window())).filter("rank <= 5").orderBy("rank").collect()
    assert top_k(df, 5, parts=400).orderBy("rank").select(*plain[0].__fields__).collect() == plain
    plan = top_k(df, 5, parts=400)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number()") == 2
    sliced = (df.withColumn("__slice", F.pmod(F.xxhash64("docno"), F.lit(20)))
              .withColumn("__at", F.row_number().over(rank_window(["qid", "__slice"]))).filter("__at <= 5"))
    assert sliced.count() == 100        # what the last window gets
    assert top_k(df, 5)._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number()") == 1


def test_histogram_looks_at_the_rows_once(spark):
    docs = an.with_lengths(tables.corpus(spark, SF))
    h = an.histogram(docs, "n_words", 50)
    assert "documents.parquet" not in h._jdf.queryExecution().executedPlan().toString()
    assert sum(r["count"] for r in h.collect()) == docs.count() and h.count() == 50
    some = spark.createDataFrame([(1.5,), (None,), (1.5,), (4.5,)], "x double")
    assert [(r.lo, r.hi, r["count"]) for r in an.histogram(some, "x", 3).collect()] == [(1.5, 2.5, 2), (2.5, 3.5, 0), (3.5, 4.5, 1)]
    same = spark.createDataFrame([(2,)] * 3, "x int")
    assert [r["count"] for r in an.histogram(same, "x", 2).collect()] == [3, 0]
    empty = an.histogram(same.limit(0), "x", 2).collect()
    assert [(r.lo, r["count"]) for r in empty] == [(None, 0)] * 2


def test_text_of_a_few_documents_opens_their_buckets(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "docno long, text string")
    idx = ix.build_index(docs, scratch_path(spark, "lookup"), doc_buckets=16, term_buckets=2)
    run = spark.createDataFrame([(1, 7), (2, 9), (2, 7), (3, None)], "qid int, docno long")
    got = ix.get_text(run, idx)
    assert sorted((r.qid, r.text) for r in got.collect() if r.text) == [(1, "text 7"), (2, "text 7"), (2, "text 9")]
    assert got.count() == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(docno, [7,9])" in plan       # bucket and row group pruning follow from the literals
    many = run.crossJoin(spark.range(100)).select("qid", F.col("id").alias("docno"))
    assert ix.get_text(many, idx).filter("text is null").count() == 0


def test_expansion_scans_documents_once(spark):
    docs = tables.corpus(spark, SF)
    plan = final_plan(kw.expand_documents(docs, thesaurus.fixture(spark), replace=False))
    assert plan.count("FileScan") == 1


def test_stored_tables_are_written_once(spark):
    df = spark.range(5)
    once = stored(df, "five")
    assert stored(once, "five") is once and once.count() == 5


def test_models_are_made_once_a_worker_and_called_in_batches(spark, tmp_path):
    log = str(tmp_path)

    def make():
        open(f"{log}/made-{os.getpid()}", "a").write("x")
        return lambda prompts: [p[-1]["content"].upper() for p in prompts]

    model = worker_model(make)

    def answer(prompts):
        open(f"{log}/calls-{os.getpid()}", "a").write(f"{len(prompts)} ")
        return model()(prompts)

    rows = [(i, [("user", f"q{i}")]) for i in range(100)]
    prompts = spark.createDataFrame(rows, f"qid int, messages {an_.MESSAGE}").repartition(5)
    got = {r.qid: r.answer for r in an_.generate(prompts, answer, batch_size=8).collect()}
    got2 = an_.generate(prompts, answer, batch_size=8).count()
    assert got == {i: f"Q{i}" for i in range(100)} and got2 == 100
    names = os.listdir(log)
    assert names and all(open(f"{log}/{n}").read() == "x" for n in names if n.startswith("made-"))
    sizes = [int(s) for n in names if n.startswith("calls-") for s in open(f"{log}/{n}").read().split()]
    assert max(sizes) == 8 and len(sizes) < 2 * 100 / 4


def test_stand_in_answer(spark):
    ctx = "CONTEXT NUMBER: 1\nDOCUMENT ID: 1\nd7\n\nthe passage\n\n"
    rows = [(1, [("system", "s"), ("tool", ctx), ("user", "q")]), (2, [("system", "s"), ("user", ctx + "\n\nq")]),
            (3, [("tool", ""), ("user", "q")]), (4, [("user", "just a question")]), (5, [])]
    p = spark.createDataFrame(rows, f"qid int, messages {an_.MESSAGE}")
    assert [(r.qid, r.answer) for r in an_.generate(p).orderBy("qid").collect()] == [
        (1, "the passage"), (2, "the passage"), (3, ""), (4, ""), (5, "")]


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_learned_similarity_against_numpy(spark, monkeypatch, limit):
    """Vectors learned in Spark; ranking by numpy.  Also with split terms instead of a broadcast."""
    monkeypatch.setattr(kw, "BROADCAST_MAX_BYTES", limit)
    docs = tables.corpus(spark, SF)
    tv, dv = kw.learned_vectors(docs, dims=8)
    vec = {r.term: np.array(r.vec) for r in tv.collect()}
    doc = {r.docno: np.array(r.vec) for r in dv.collect()}
    from quarry.functions.text import tokens
    want = {}
    for r in docs.select("docno", F.array_distinct(tokens(F.col("text"))).alias("t")).collect():
        known = [t for t in r.t if t in vec]
        sim = lambda t: round(float(vec[t] @ doc[r.docno] / (np.linalg.norm(vec[t]) * np.linalg.norm(doc[r.docno]))), 5)
        want[r.docno] = sorted((-sim(t), t) for t in known)
    got = collections.defaultdict(list)
    for r in kw.similarity_keywords(docs, tv, dv).collect():
        got[r.docno].append((r.kw_rank, r.keyword))
    assert set(got) == {d for d, w in want.items() if w}
    for d, rows in got.items():
        assert len(rows) == min(3, len(want[d]))
        by_term = {t: s for s, t in want[d]}
        for (rank, term), (best, _) in zip(sorted(rows), want[d]):
            assert abs(by_term[term] - best) <= 2e-5


def test_a_task_sorts_the_postings_of_one_bucket(spark):
    """Small buckets are not packed into one task, whose sort would hold them all."""
    docs = spark.createDataFrame([(i, f"word{i % 7} text {i}") for i in range(400)], "docno long, text string")
    path = scratch_path(spark, "packed")
    idx = ix.build_index(docs, path, doc_buckets=48, term_buckets=2)
    files = [r.f.rsplit("/", 1)[1] for r in idx.postings.select(F.input_file_name().alias("f")).distinct().collect()]
    of_task = collections.defaultdict(set)
    for f in files:                      # part-<task>-<job>_<bucket>.c000...
        of_task[f.split("-")[1]].add(f.rsplit("_", 1)[1].split(".")[0])
    assert len(of_task) > 40 and all(len(buckets) == 1 for buckets in of_task.values())
    assert spark.conf.get(ix.PACKED_BUCKETS) == "true"
