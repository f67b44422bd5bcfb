import math

import pytest

from quarry.operators import evaluate as ev


def _run(spark, rows):
    return spark.createDataFrame(rows, "qid string, docno string, rank int")


def _qrels(spark, rows):
    return spark.createDataFrame(rows, "qid string, docno string, relevance int")


def _per(spark, run_rows, qrel_rows, topics=None):
    t = spark.createDataFrame([(q,) for q in topics], "qid string") if topics else None
    return {r.qid: r.asDict() for r in ev.per_query(_run(spark, run_rows), _qrels(spark, qrel_rows), t).collect()}


def ranks(rel_at, n=12):
    return [(str(i), "d" + str(i), i) for i in range(1, n + 1)]


def test_single_relevant_at_various_ranks(spark):
    run = []
    for q, r in (("a", 1), ("b", 3), ("c", 11)):
        run += [(q, f"{q}{i}", i) for i in range(1, 13)]
    qrels = [("a", "a1", 1), ("b", "b3", 1), ("c", "c11", 1), ("d", "dX", 1)]
    m = _per(spark, run, qrels)
    assert m["a"]["p_1"] == 1.0 and m["a"]["ap"] == 1.0 and m["a"]["ndcg_5"] == 1.0
    assert m["b"]["p_1"] == 0.0 and m["b"]["p_5"] == 0.2 and m["b"]["r_5"] == 1.0
    assert m["b"]["ap"] == round(1 / 3, 6)
    assert m["b"]["ndcg_5"] == round(1 / math.log2(4), 6)
    assert m["c"]["p_10"] == 0.0 and m["c"]["r_10"] == 0.0 and m["c"]["ap"] == round(1 / 11, 6)
    # judged topic without results scores 0 everywhere
    assert all(m["d"][k] == 0.0 for k in ("p_1", "p_5", "p_10", "r_5", "r_10", "ndcg_5", "ndcg_10", "ap"))


def test_several_relevant_and_graded(spark):
    run = [("q", f"d{i}", i) for i in range(1, 6)]
    qrels = [("q", "d1", 2), ("q", "d3", 1), ("q", "d9", 1), ("q", "d2", 0), ("q", "d1", 1)]
    m = _per(spark, run, qrels)["q"]
    assert m["p_5"] == 0.4 and m["r_5"] == round(2 / 3, 6)
    assert m["ap"] == round((1 / 1 + 2 / 3) / 3, 6)
    dcg = 2 / math.log2(2) + 1 / math.log2(4)
    idcg = 2 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert m["ndcg_5"] == pytest.approx(round(dcg / idcg, 6))


def test_topic_restriction_and_unjudged(spark):
    run = [("a", "x", 1), ("z", "y", 1)]
    qrels = [("a", "x", 1), ("b", "w", 1)]
    m = _per(spark, run, qrels, topics=["a", "z"])
    assert set(m) == {"a"}  # b not run, z has no judgments


def test_metrics_table_means_over_judged(spark):
    runs = spark.createDataFrame([("s1", "a", "x", 1), ("s2", "a", "y", 1)],
                                 "name string, qid string, docno string, rank int")
    qrels = _qrels(spark, [("a", "x", 1), ("b", "w", 1)])
    t = {r.name: r.asDict() for r in ev.metrics_table(runs, qrels).collect()}
    assert t["s1"]["p_1"] == 0.5 and t["s1"]["map"] == 0.5
    assert t["s2"]["p_1"] == 0.0


def test_precision_bounded_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.integers(1, 30), min_size=1, max_size=10, unique=True))
    def check(rel_ranks):
        run = [("q", f"d{i}", i) for i in range(1, 31)]
        qrels = [("q", f"d{r}", 1) for r in rel_ranks]
        m = _per(spark, run, qrels)["q"]
        assert all(0.0 <= m[k] <= 1.0 for k in m if k != "qid")
        if len(rel_ranks) == 1:
            assert m["ap"] == round(1 / rel_ranks[0], 6)
    check()


def test_labels_meet_the_run_by_broadcast(spark):
    """A run of a thousand rows a query is not shuffled to meet its documents' labels."""
    from quarry.session import setting
    run = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1)], "qid int, docno int, rank int")
    dl = spark.createDataFrame([(5, "a"), (6, "b")], "docno int, label string")
    ql = spark.createDataFrame([(1, "b"), (2, "a")], "qid int, label string")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        hits = ev.label_hits(run, dl, ql)
        assert sorted((r.qid, r.docno, r.rank) for r in hits.collect()) == [(1, 6, 2), (2, 5, 1)]
        assert "SortMergeJoin" not in hits._jdf.queryExecution().executedPlan().toString()
