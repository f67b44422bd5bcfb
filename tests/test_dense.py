import pytest

from quarry.operators import dense as de


def test_exhaustive_hand_computed_with_tie(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "docno int, vec array<float>")
    q = spark.createDataFrame([(7, [2.0, 2.0]), (8, [1.0, 0.0])], "qid int, vec array<float>")
    got = sorted(tuple(r) for r in de.exhaustive_topk(docs, q, k=2).collect())
    # q7: d3=4, d1=2, d2=2 (tie -> smaller docno); q8: d1=1, d3=1 (tie), d2=0
    assert got == [(7, 1, 2.0, 2), (7, 3, 4.0, 1), (8, 1, 1.0, 1), (8, 3, 1.0, 2)]


def test_exhaustive_partition_invariance(spark):
    import random
    rnd = random.Random(1)
    docs = spark.createDataFrame([(i, [rnd.random() for _ in range(4)]) for i in range(300)], "docno int, vec array<float>")
    q = spark.createDataFrame([(i, [rnd.random() for _ in range(4)]) for i in range(5)], "qid int, vec array<float>")
    a = sorted(tuple(r) for r in de.exhaustive_topk(docs.repartition(1), q, k=7).collect())
    b = sorted(tuple(r) for r in de.exhaustive_topk(docs.repartition(6), q, k=7).collect())
    assert a == b and len(a) == 35
    # same scores as the pairwise re-ranker on those pairs
    run = spark.createDataFrame([(r[0], r[1]) for r in a], "qid int, docno int")
    c = {(r.qid, r.docno): r.score for r in de.rerank(run, docs, q).collect()}
    assert all(c[(r[0], r[1])] == pytest.approx(r[2]) for r in a)


def test_encode_hook(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "docno int, text string")
    v = {r.docno: r.vec for r in de.encode(docs, de.hashed_encoder(8)).collect()}
    assert len(v[1]) == 8 and sum(x * x for x in v[1]) == pytest.approx(1.0, rel=1e-5)
    assert sum(v[2]) == 0.0


def test_dense_index_build_open(spark, scratch):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a")], "docno int, text string")
    path = scratch("dense-idx")
    v = de.build_dense_index(docs, path, de.hashed_encoder(4), buckets=2)
    assert v.count() == 3
    with pytest.raises(RuntimeError):
        de.build_dense_index(docs, path, de.hashed_encoder(4))
    again = de.open_dense_index(spark, path)
    assert sorted(r.docno for r in again.collect()) == [1, 2, 3]
    with pytest.raises(RuntimeError):
        de.open_dense_index(spark, path + "-none")


def test_similarity_keywords(spark):
    from quarry.operators import keywords as kw
    docs = spark.createDataFrame([(1, "alpha beta gamma the")], "docno int, text string")
    tv = spark.createDataFrame([("alpha", [1.0, 0.0]), ("beta", [0.0, 1.0]), ("gamma", [0.7, 0.7])],
                               "term string, vec array<double>")
    dv = spark.createDataFrame([(1, [1.0, 0.1])], "docno int, vec array<double>")
    got = [r.keyword for r in kw.keywords_extractor(docs, 2, "bert", term_vectors=tv, doc_vectors=dv)
           .orderBy("kw_rank").collect()]
    assert got == ["alpha", "gamma"]


def test_dense_index_reopen_in_fresh_catalog(spark, scratch):
    from quarry.operators.index import _table_name
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "docno int, text string")
    path = scratch("dense-idx2")
    de.build_dense_index(docs, path, de.hashed_encoder(4), buckets=5)   # some buckets empty
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(path, 'vectors')}")   # as in a new session
    assert sorted(r.docno for r in de.open_dense_index(spark, path).collect()) == [1, 2]


def test_every_vector_asks(spark):
    """No query of the registered searches is left out, in Spark or in SQL."""
    import __spark_entry__ as E
    from quarry.plans import queries as q
    from quarry.sources import tables
    n = tables.vectors(spark, "/root/testdata/sf0.001").count()
    ql = q._asking(q._vectors(spark, "/root/testdata/sf0.001"))
    assert n > 20 and ql.select("qid").distinct().count() == n
    for name in ("dense_topk", "dense_label_metrics"):
        assert E.queries()[name](spark, "/root/testdata/sf0.001").select("qid").distinct().count() == n
        assert "% 20" not in E.oracle_sql()[name]


def test_vectors_of_a_large_lexicon(spark, scratch, monkeypatch):
    """Common terms are broadcast, rows of rare ones shuffled: the vectors stay those of one join."""
    from quarry.operators import index as ix
    rows = [(i, " ".join([f"common{i % 3}", f"half{i % 20}", f"half{i % 20}", f"rare{i}"])) for i in range(120)]
    docs = spark.createDataFrame([*rows, (500, None), (501, "rare7"), (7, "common1 again")], "docno long, text string")
    idx = ix.build_index(docs, scratch("large-lexicon"), doc_buckets=4, term_buckets=2)
    lex = idx.lexicon.select("term", "df")
    topics = spark.createDataFrame([(1, "common1 rare5"), (2, "unknownword"), (3, None)], "qid int, query string")
    got = {}
    for size in (1 << 20, 600, 1):
        monkeypatch.setattr(de, "COMMON_BYTES", size)
        got[size] = (sorted(map(tuple, de.document_vectors(idx).collect())),
                     sorted(map(tuple, de.query_vectors(topics, idx).collect())))
    assert de._common_from(lex, 1 << 20)[1] and de._common_from(lex, 1) == (None, False)
    least, whole = de._common_from(lex, 600)
    assert 2 < least <= 32 and not whole
    assert got[1 << 20] == got[600] == got[1] and len(got[1][0]) == docs.count()
    assert all(any(v) == (d != 500) for d, v in got[1][0])
    monkeypatch.setattr(de, "COMMON_BYTES", 600)
    plan = de.document_vectors(idx)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("broadcast") == 2
