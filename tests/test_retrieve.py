import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import index as ix
from quarry.operators import retrieve as rt

DOCS = [(1, "apple banana apple"), (2, "banana cherry"), (3, "cherry cherry cherry date"),
        (4, ""), (5, "apple date fig")]
TOPICS = [(10, "apple cherry"), (11, "fig fig banana"), (12, "zzz unknown")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    from quarry.session import scratch_path
    docs = spark.createDataFrame(DOCS, "docno long, text string")
    idx = ix.build_index(docs, scratch_path(spark, "t-idx"), doc_buckets=3, term_buckets=4)
    topics = spark.createDataFrame(TOPICS, "qid long, query string")
    return idx, topics, docs


def bm25_expected(q, d, docs):
    toks = {k: v.split() for k, v in docs}
    n = len(docs)
    avgdl = sum(len(t) for t in toks.values()) / n
    s = 0.0
    for term in set(q.split()):
        qtf = q.split().count(term)
        df = sum(term in t for t in toks.values())
        if df == 0 or term not in toks[d]:
            continue
        tf = toks[d].count(term)
        idf = math.log2((n - df + 0.5) / (df + 0.5))
        s += qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks[d]) / avgdl))
    return round(s, 6)


def test_index_stats(small):
    idx, _, _ = small
    assert idx.n_docs == 5 and idx.n_tokens == 12 and idx.n_terms == 5
    lex = {r.term: (r.df, r.cf) for r in ix.lexicon(idx).collect()}
    assert lex["cherry"] == (2, 4) and lex["apple"] == (2, 3)
    dl = {r.docno: r.dl for r in idx.doc_stats.collect()}
    assert dl[4] == 0 and dl[3] == 4


def test_build_errors_if_exists(small, spark):
    idx, _, docs = small
    with pytest.raises(RuntimeError):
        ix.build_index(docs, idx.path)
    with pytest.raises(RuntimeError):
        ix.open_index(spark, idx.path + "-missing")


def test_bm25_hand_computed(small):
    idx, topics, _ = small
    run = rt.bm25(idx, rt.query_terms(topics, idx), k=10).collect()
    got = {(r.qid, r.docno): r.score for r in run}
    for qid, q in TOPICS:
        for d, _ in DOCS:
            e = bm25_expected(q, d, DOCS)
            if (qid, d) in got:
                assert got[(qid, d)] == pytest.approx(e, abs=1e-6)
    assert not any(r.qid == 12 for r in run)   # no query term in the vocabulary
    ranks = sorted((r.rank, r.docno) for r in run if r.qid == 10)
    assert [r for r, _ in ranks] == list(range(1, len(ranks) + 1))


def test_cutoff_idempotent(small):
    idx, topics, _ = small
    run = rt.bm25(idx, rt.query_terms(topics, idx), k=10)
    a = sorted(tuple(r) for r in rt.cutoff(run, 2).collect())
    b = sorted(tuple(r) for r in rt.cutoff(rt.cutoff(run, 2), 2).collect())
    assert a == b and all(r[3] <= 2 for r in a)


def test_partition_count_invariance(spark, small):
    from quarry.session import scratch_path
    idx, topics, docs = small
    idx1 = ix.build_index(docs.repartition(1), scratch_path(spark, "t-idx1"), doc_buckets=1, term_buckets=1)
    a = sorted(tuple(r) for r in rt.bm25(idx, rt.query_terms(topics, idx)).collect())
    b = sorted(tuple(r) for r in rt.bm25(idx1, rt.query_terms(topics, idx1)).collect())
    assert a == b


def test_rm3_lambda_one_is_base_ranking(small):
    idx, topics, _ = small
    qt = rt.query_terms(topics, idx)
    base = rt.bm25(idx, qt)
    again = rt.retrieve(idx, rt.rm3_terms(idx, base, qt, fb_lambda=1.0), "BM25")
    order = lambda df: sorted((r.qid, r.rank, r.docno) for r in df.collect())
    assert order(base) == order(again)


def test_rm3_terms_sum(small):
    idx, topics, _ = small
    qt = rt.query_terms(topics, idx)
    w = rt.rm3_terms(idx, rt.bm25(idx, qt), qt, fb_terms=2)
    sums = {r.qid: r.s for r in w.groupBy("qid").agg(F.sum("weight").alias("s")).collect()}
    assert sums[10] == pytest.approx(1.0, abs=1e-6)


def test_bm25f_text_only_matches_bm25_order(spark):
    from quarry.session import scratch_path
    docs = spark.createDataFrame([(d, t, "") for d, t in DOCS], "docno long, text string, keywords string")
    idx2 = ix.build_index(docs, scratch_path(spark, "t-idx2"), fields=("text", "keywords"), doc_buckets=2)
    topics = spark.createDataFrame(TOPICS, "qid long, query string")
    qt = rt.query_terms(topics, idx2)
    f = sorted((r.qid, r.rank, r.docno) for r in rt.bm25f(idx2, qt, (1.0, 0.0)).collect())
    idx1 = ix.build_index(docs.select("docno", "text"), scratch_path(spark, "t-idx3"), doc_buckets=2)
    b = sorted((r.qid, r.rank, r.docno) for r in rt.bm25(idx1, qt).collect())
    assert f == b
    # zero weight on the only matching field drops the pair
    assert rt.bm25f(idx2, qt, (0.0, 1.0)).count() == 0


def test_unknown_model(small):
    idx, topics, _ = small
    with pytest.raises(ValueError):
        rt.retrieve(idx, rt.query_terms(topics, idx), "LM")


def test_unstored_index_same_ranking(spark, small):
    from quarry.session import scratch_path
    idx, topics, docs = small
    bare = ix.build_index(docs, scratch_path(spark, "t-bare"), doc_buckets=3, term_buckets=4, store=False)
    assert bare.n_docs == 5 and "text" not in bare.docs.columns
    a = sorted(tuple(r) for r in rt.bm25(idx, rt.query_terms(topics, idx)).collect())
    b = sorted(tuple(r) for r in rt.bm25(bare, rt.query_terms(topics, bare)).collect())
    assert a == b
    with pytest.raises(ValueError):
        ix.get_text(rt.bm25(bare, rt.query_terms(topics, bare)), bare)
    again = ix.open_index(spark, bare.path)
    assert again.docs.count() == 5


def test_auto_doc_buckets_uses_file_scans_only(spark):
    from quarry.operators.keywords import expand_documents
    from quarry.sources import tables, thesaurus
    floor = spark.sparkContext.defaultParallelism
    mem = spark.createDataFrame([(1, "a")], "docno int, text string")
    assert ix.auto_doc_buckets(mem) == floor
    d = tables.corpus(spark, "/root/testdata/sf0.1")
    one_mb = ix.auto_doc_buckets(d, 1024 * 1024)
    assert floor <= one_mb < 100
    # joins with in-memory tables and self-joins do not inflate the estimate
    assert ix.auto_doc_buckets(expand_documents(d, thesaurus.fixture(spark), replace=False), 1024 * 1024) == one_mb


def test_index_keeps_its_own_stop_list(spark):
    from quarry.session import scratch_path
    docs = spark.createDataFrame([(1, "the sky above"), (2, "the sea"), (3, "sky")], "docno long, text string")
    topics = spark.createDataFrame([(7, "the sky")], "qid long, query string")
    path = scratch_path(spark, "t-stops")
    idx = ix.build_index(docs, path, doc_buckets=2, stop_words=("sky",))
    assert idx.stop_words == ("sky",)
    assert sorted(r.docno for r in rt.bm25(idx, rt.query_terms(topics, idx)).collect()) == [1, 2]
    free = ix.build_index(docs, scratch_path(spark, "t-free"), doc_buckets=2, stop_words=None)
    assert sorted(r.docno for r in rt.bm25(free, rt.query_terms(topics, free)).collect()) == [1, 2, 3]
    assert ix.build_index(docs, path, stop_words=("sky",), mode="ignore").build_id == idx.build_id
    with pytest.raises(ValueError):
        ix.build_index(docs, path, mode="ignore")


def test_bucket_count_measures_what_is_not_a_file(spark):
    docs = spark.range(4000).selectExpr("id docno", "repeat('x', 100) text")
    cores = spark.sparkContext.defaultParallelism
    assert ix.auto_doc_buckets(docs) == cores
    assert ix.auto_doc_buckets(docs, target_bytes=10_000) == 47      # 4000 * (8 + 108) bytes


def test_broadcast_is_bounded_in_bytes(spark):
    from quarry.operators.util import broadcast_if_small, known_size
    df = spark.createDataFrame([("a" * 100,), (None,)], "t string")
    assert known_size(df) == (2, 116)
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(df, 116)) and not hinted(broadcast_if_small(df, 115))


def test_short_and_empty_passages_are_judged(spark):
    from quarry.operators.judgments import containment_qrels
    texts = {1: "big red fox runs", 2: "a hundred foxes", 3: "", 4: None, 5: "red fox", 6: "?! fox", 7: "Red fox and the dog barks"}
    passages = {1: "red fox", 2: "fox", 3: "", 4: None, 5: "?!", 6: "d fox", 7: "big red fox runs", 8: "ox and the dog ba"}
    docs = spark.createDataFrame(list(texts.items()), "docno long, text string")
    p = spark.createDataFrame(list(passages.items()), "qid long, text string")
    got = sorted((r.qid, r.docno) for r in containment_qrels(docs, p).collect())
    assert got == sorted((q, d) for q, a in passages.items() for d, t in texts.items()
                         if a is not None and t is not None and a in t)


def test_judgments_are_linear_in_a_document(spark):
    """One document of 20,000 different words: comparing all pairs of its windows took a minute."""
    import time

    from quarry.operators.judgments import containment_qrels
    words = [f"w{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w1 w2")], "docno long, text string")
    p = spark.createDataFrame([(1, " ".join(words[19_000:19_030])), (2, "w7 w9")], "qid long, text string")
    containment_qrels(docs, p).collect()
    start = time.time()
    assert [(r.qid, r.docno) for r in containment_qrels(docs, p).collect()] == [(1, 1)]
    assert time.time() - start < 20


def test_documents_that_repeat_are_one_in_the_index(spark):
    """Same id and length: frequencies add up; terms are counted in sorted arrays, the lexicon has many files a bucket."""
    from quarry.session import scratch_path
    docs = spark.createDataFrame([(1, "b a b"), (1, "b c c"), (2, ""), (None, "a")], "docno long, text string")
    idx = ix.build_index(docs, scratch_path(spark, "repeats"), doc_buckets=2, term_buckets=2, stop_words=None)
    got = {(r.docno, r.dl): sorted(map(tuple, r.terms)) for r in idx.forward.collect()}
    assert got == {(1, 3): [("a", 1), ("b", 3), ("c", 2)], (2, 0): [], (None, 1): [("a", 1)]}
    assert sorted(map(tuple, ix.lexicon(idx).collect())) == [("a", 2, 2), ("b", 1, 3), ("c", 1, 2)]
    assert ix.TARGET_BUCKET_BYTES <= 64 << 20


def test_bm25f_queries_build_the_index_they_ask(spark, scratch, monkeypatch):
    """Terms of the queries come by the two-field index's own rule; no other index of the documents is built for it."""
    from quarry.plans import indexes, queries
    from quarry.plans.registry import REGISTRY
    sf = scratch("two-fields-only")
    spark.createDataFrame([(1, "apple banana. the apple"), (2, "cherry date; fig"), (3, None)], "doc_id long, text string") \
        .write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(5, "the apple fig")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    monkeypatch.setattr(indexes, "basic_index", lambda *a: pytest.fail("another index"))
    assert sorted((r.qid, r.docno) for r in REGISTRY["bm25f_mixed"][0](spark, sf).collect()) == [(5, 1), (5, 2)]
    assert queries.indexes is indexes
