import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import collection as co
from quarry.sources import json_io


def _records(spark, rows):
    return spark.createDataFrame(rows, "pos int, para_id string, context string")


def test_dedup_keep_first(spark):
    s1 = _records(spark, [(0, "a", "a1"), (1, "b", "b1")])
    s2 = _records(spark, [(0, "b", "b2"), (1, "c", "c2"), (2, "", "e2"), (3, None, "n2")])
    u = co.union_splits(s1, s2)
    d = co.dedup_keep_first(u).orderBy("src_ord", "pos")
    got = [(r.para_id, r.context) for r in d.collect()]
    assert got == [("a", "a1"), ("b", "b1"), ("c", "c2")]
    # idempotent
    again = co.dedup_keep_first(d).orderBy("src_ord", "pos")
    assert [(r.para_id, r.context) for r in again.collect()] == got


def test_project_fills_missing(spark):
    df = spark.createDataFrame([("x", None)], "para_id string, context string")
    r = co.project(df).first()
    assert (r.para_id, r.context, r.raw_ocr, r.publication_date) == ("x", "", "", "")


def test_topic_order_numeric_then_strings(spark):
    df = spark.createDataFrame([("10", "q"), ("9", "q"), ("2", "q"), ("x1", "q")], "query_id string, question string")
    got = [r.query_id for r in co.build_topics(df, normalize=False).collect()]
    assert got == ["2", "9", "10", "x1"]
    assert [r.query_id for r in co.build_topics(df, first_n=2, normalize=False).collect()] == ["2", "9"]


def test_sample_reproducible_and_bounded(spark):
    t = spark.range(50).select(F.col("id").alias("qid"))
    a = [r.qid for r in co.sample_topics(t, 10, 42).collect()]
    b = [r.qid for r in co.sample_topics(t.repartition(5), 10, 42).collect()]
    assert a == b and len(set(a)) == 10
    assert co.sample_topics(t, 1000).count() == 50
    assert [r.qid for r in co.sample_topics(t, 10, 7).collect()] != a


def test_broken_files(spark, tmp_path):
    d = tmp_path
    (d / "zero.json").write_text("")
    (d / "trunc.json").write_text('[{"para_id": "a", "context": "x"}, {"para_id": ')
    (d / "obj.json").write_text('{"data": [{"para_id": "a"}]}')
    (d / "ok.json").write_text('[{"para_id": "a", "context": "x"}, {"para_id": "b", "question": "q?"}]')
    (d / "bad.json").write_text('not json at all')
    p = lambda n: "file://" + str(d / n)
    assert json_io.load_list_or_empty(spark, str(d / "missing.json")).count() == 0
    for n in ("zero.json", "trunc.json", "obj.json", "bad.json"):
        assert json_io.load_list_or_empty(spark, p(n)).count() == 0, n
    ok = json_io.load_list_or_empty(spark, p("ok.json")).orderBy("pos").collect()
    assert [(r.pos, r.para_id, r.context, r.question) for r in ok] == [(0, "a", "x", None), (1, "b", None, "q?")]


def test_missing_input_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        json_io.check_paths(spark, str(tmp_path / "nope.json"))
    with pytest.raises(FileNotFoundError):
        json_io.load_documents(spark, str(tmp_path / "nope.json"))


def test_json_roundtrip_and_preview(spark, tmp_path):
    src = tmp_path / "coll.json"
    src.write_text('[{"para_id": "p1", "context": "hello", "raw_ocr": "h", "publication_date": "1900"}]')
    docs = json_io.load_documents(spark, "file://" + str(src))
    assert [tuple(r) for r in docs.collect()] == [("p1", "hello")]
    out = str(tmp_path / "out")
    json_io.write_json(docs, out)
    assert [tuple(r) for r in spark.read.json(out).select("docno", "text").collect()] == [("p1", "hello")]
    pv = json_io.preview(spark, "file://" + str(src)).first()
    assert pv.kind == "list" and pv.n_items == 1 and "para_id" in pv.keys
    assert os.path.exists(out)


def test_qrels_and_answers(spark):
    t = spark.createDataFrame([("7", "p", "a", "oa"), (None, "q", None, None)],
                              "query_id string, para_id string, answer string, org_answer string")
    q = [tuple(r) for r in co.build_qrels(t).collect()]
    assert q == [("7", 0, "p", 1), ("", 0, "q", 1)]
    a = [tuple(r) for r in co.build_answers(t).collect()]
    assert a[1] == ("", 0, "q", 1, "", "")


def test_document_splits_cover_whole_table(spark):
    from conftest import SF_CHECK
    from quarry.sources import tables
    splits = tables.document_splits(spark, SF_CHECK)
    n = tables.corpus(spark, SF_CHECK).count()
    sizes = [s.count() for s in splits]
    assert sum(sizes) == n and all(x > 0 for x in sizes)          # a partition, nothing dropped
    u = co.union_splits(*splits)
    per_id = u.groupBy("para_id").agg(F.countDistinct("src_ord").alias("k"))
    assert per_id.filter("k > 1").count() > 0                     # ids repeated across splits
    d = co.dedup_keep_first(u)
    assert d.count() == u.select("para_id").distinct().count()


def test_globs_and_other_columns_of_topics(spark, tmp_path):
    import json
    from quarry.session import path_exists, source_key
    from quarry.sources import json_io
    (tmp_path / "a1.json").write_text(json.dumps([{"query_id": 7, "question": "q", "answer": "x", "year": 1901}]))
    glob = str(tmp_path / "a*.json")
    assert path_exists(spark, glob) and not path_exists(spark, str(tmp_path / "b*.json"))
    assert json_io.load_list_or_empty(spark, glob).count() == 1
    r = json_io.load_queries(spark, glob).first().asDict()
    assert r == {"qid": "7", "query": "q", "answer": "x", "year": "1901"}
    before = source_key(spark, str(tmp_path))
    (tmp_path / "a2.json").write_text("[]")
    assert source_key(spark, str(tmp_path)) != before
