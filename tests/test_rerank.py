
from quarry.operators import rerank as rr


def test_sliding_windows(spark):
    lengths = [0, 255, 256, 257, 384, 385, 512]
    docs = spark.createDataFrame(
        [(n, " ".join(f"w{i}" for i in range(n))) for n in lengths], "docno int, text string")
    got = {}
    for r in rr.sliding(docs, 256, 128).collect():
        first = r.text.split()[0] if r.text else None
        got.setdefault(r.docno, []).append((r.passage_no, first, len(r.text.split())))
    assert got[0] == [(0, None, 0)]
    assert got[255] == [(0, "w0", 255)]
    assert got[256] == [(0, "w0", 256)]
    assert got[257] == [(0, "w0", 256), (1, "w128", 129)]
    assert got[384] == [(0, "w0", 256), (1, "w128", 256)]
    assert got[385] == [(0, "w0", 256), (1, "w128", 256), (2, "w256", 129)]
    assert got[512] == [(0, "w0", 256), (1, "w128", 256), (2, "w256", 256)]


def test_sliding_prepend(spark):
    docs = spark.createDataFrame([(1, "a b c", "T")], "docno int, text string, title string")
    r = rr.sliding(docs, 2, 1, prepend_attr="title").collect()
    assert [x.text for x in r] == ["T a b", "T b c"]


def test_max_passage_best_and_tie(spark):
    s = spark.createDataFrame([(1, 10, 0, 0.5, "p0"), (1, 10, 1, 0.9, "p1"), (1, 10, 2, 0.9, "p2"),
                               (1, 11, 0, 0.7, "q0")],
                              "qid int, docno int, passage_no int, score double, text string")
    got = [tuple(r) for r in rr.max_passage(s).orderBy("rank").collect()]
    assert got == [(1, 10, 0.9, "p1", 1), (1, 11, 0.7, "q0", 2)]


def test_model_scores_batches(spark):
    calls = []

    def score_fn(qs, ts):
        calls.append(len(qs))
        return [float(len(t)) for t in ts]
    pairs = spark.createDataFrame([(1, i, "q", "x" * i) for i in range(40)],
                                  "qid int, docno int, query string, text string").coalesce(1)
    out = rr.model_scores(pairs, score_fn, batch_size=16)
    assert sorted(r.score for r in out.collect()) == [float(i) for i in range(40)]


def test_top_passages_are_those_of_max_passage(spark):
    """Texts are joined to the rows returned only; same rows as the head of the whole ranking."""
    from pyspark.sql import functions as F

    from quarry.operators import index as ix
    from quarry.operators import rerank as rr
    from quarry.session import scratch_path
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 13}" for j in range(5 * i + 1))) for i in range(30)]
                                 + [(3, "w1 w2")], "docno long, text string")
    idx = ix.build_index(docs, scratch_path(spark, "topp"), doc_buckets=2, term_buckets=2, stop_words=None)
    topics = spark.createDataFrame([(1, "w1 w5 w7"), (2, "w2 w2 w11"), (3, "none")], "qid int, query string")
    run = spark.range(30).select((F.col("id") % 3 + 1).cast("int").alias("qid"), F.col("id").alias("docno"),
                                 F.lit(1).alias("rank"))
    whole = rr.max_passage(rr.coverage_scores(rr.run_passages(run, idx, 6, 3), topics, idx), 2)
    got = rr.top_passages(run, topics, idx, 2, 6, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() == 6


def test_top_passages_look_terms_up_by_document(spark, monkeypatch):
    """Each passage of each pair was intersected with its query; now blocks of documents look terms up."""
    from pyspark.sql import functions as F

    from quarry.operators import index as ix
    from quarry.session import scratch_path
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j * j) % 17}" for j in range(7 * i))) for i in range(20)]
                                 + [(40, None)], "docno long, text string")
    idx = ix.build_index(docs, scratch_path(spark, "topl"), doc_buckets=2, term_buckets=2, stop_words=None)
    topics = spark.createDataFrame([("a", "w1 w5 w7"), ("b", "w2 w2 w11 w16"), ("c", "")], "qid string, query string")
    run = topics.select("qid").crossJoin(spark.range(41).select(F.col("id").alias("docno"))).withColumn("rank", F.lit(1))
    whole = rr.max_passage(rr.coverage_scores(rr.run_passages(run, idx, 6, 3), topics, idx), 5)
    want = sorted(map(tuple, whole.select("qid", "docno", "score", "text", "rank").collect()))
    assert len(want) == 15
    monkeypatch.setattr(rr, "coverage_scores", None)
    got = rr.top_passages(run, topics, idx, 5, 6, 3)
    assert sorted(map(tuple, got.select("qid", "docno", "score", "text", "rank").collect())) == want


def test_best_passages_in_parts(monkeypatch):
    """The parts of a block's look-ups change nothing."""
    import pyarrow as pa
    passages = pa.table({"docno": pa.array([2, 1, 1, 2, 2], pa.int64()), "passage_no": pa.array([1, 0, 1, 0, 2], pa.int32()),
                         "same": pa.array([21, 10, 11, 20, 22], pa.int64()),
                         "terms": pa.array([["x", "y"], ["x"], ["x", "z"], [], ["y", "x"]], pa.list_(pa.string()))})
    asked = pa.table({"qid": pa.array([7, 8, None], pa.int64()), "docnos": pa.array([[1, 2], [2, 9], [1]], pa.list_(pa.int64())),
                      "terms": pa.array([["x", "y"], ["z"], None], pa.list_(pa.string())),
                      "idfs": pa.array([[1.0, 3.0], [2.0], None], pa.list_(pa.float64())), "total": [4.0, 2.0, 0.0]})
    want = [(7, 1, 0.25, 0, 10), (7, 2, 1.0, 1, 21), (8, 2, 0.0, 0, 20), (None, 1, 0.0, 0, 10)]
    for lookups in (1, 3, 1 << 20):
        monkeypatch.setattr(rr, "LOOKUPS", lookups)
        assert [tuple(r.values()) for r in rr._best_passages(passages, asked).to_pylist()] == want
