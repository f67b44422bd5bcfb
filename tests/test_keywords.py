from quarry.operators import keywords as kw
from quarry.sources import thesaurus as th

import pytest
from pyspark.sql import functions as F


def test_rake_two_sentences(spark):
    # phrases: "quick brown fox jumps" (4), "lazy dog" (2), "brown dog" (2)
    # word scores degree/freq: quick 4, brown (4+2)/2=3, fox 4, jumps 4, lazy 2, dog (2+2)/2=2
    # phrase scores: 15, 4, 5 -> walk "quick brown fox jumps", "brown dog", "lazy dog"
    text = "The quick brown fox jumps over the lazy dog. A brown dog!"
    docs = spark.createDataFrame([(1, text)], "docno int, text string")
    got = [r.keyword for r in kw.rake_keywords(docs, max_keywords=6).orderBy("kw_rank").collect()]
    assert got == ["quick", "brown", "fox", "jumps", "dog", "lazy"]
    top3 = [r.keyword for r in kw.rake_keywords(docs).orderBy("kw_rank").collect()]
    assert top3 == ["quick", "brown", "fox"]


def test_rake_empty_and_stopwords_only(spark):
    docs = spark.createDataFrame([(1, ""), (2, "the and of"), (3, None)], "docno int, text string")
    assert kw.rake_keywords(docs).count() == 0


def test_extractor_dispatch(spark):
    docs = spark.createDataFrame([(1, "alpha beta")], "docno int, text string")
    with pytest.raises(ValueError):
        kw.keywords_extractor(docs, method="tfidf")
    assert kw.keywords_extractor(docs).count() == 2


def test_thesaurus_rules(spark):
    t = th.fixture(spark)
    docs = spark.createDataFrame([
        (1, "de la des et le du"),        # de: sense 1 overlaps more
        (2, "der die und das zu"),        # de: sense 2 overlaps more; 'De' skipped
        (3, "the of and"),                # re: tie -> larger sense id (re.n.02)
    ], "docno int, text string")
    kws = spark.createDataFrame([(1, 1, "de"), (2, 1, "de"), (3, 1, "re"), (3, 2, "zz")],
                                "docno int, kw_rank int, keyword string")
    got = {(r.docno, r.keyword): r.synonyms for r in kw.thesaurus_expansion(docs, kws, t).collect()}
    assert got[(1, "de")] == ["of", "from the"]          # keyword itself skipped, '_' -> ' '
    assert got[(2, "de")] == ["von", "aus"]              # 'De' equals keyword in other case; stop at 2
    assert got[(3, "re")] == ["re note", "second note"]  # overlap tie -> re.n.02
    assert got[(3, "zz")] == []                          # no sense


def test_expand_queries_keeps_original(spark):
    t = th.fixture(spark)
    topics = spark.createDataFrame([(1, "der Hund und die Katze")], "qid int, query string")
    r = kw.expand_queries(topics, t).first()
    assert r.query_0 == "der Hund und die Katze"
    assert r.query.startswith(r.query_0 + " ")


def test_rake_of_long_runs_of_stop_words(spark):
    """A regex with a repeated group overflowed the stack on such a text."""
    text = "alpha beta " + "the " * 30_000 + "gamma"
    docs = spark.createDataFrame([(1, text), (1, text), (None, "delta")], "docno int, text string")
    got = sorted((r.docno or 0, r.kw_rank, r.keyword) for r in kw.rake_keywords(docs).collect())
    assert got == [(0, 1, "delta"), (1, 1, "alpha"), (1, 2, "beta"), (1, 3, "gamma")]


def test_rake_keeps_words_in_arrays(spark):
    """Words as rows were sorted, hashed and spilled; now a document is one row until its keywords."""
    docs = spark.range(1, 50).select(F.col("id").alias("docno"), F.lit("red fox. the lazy dog").alias("text"))
    plan = kw.rake_keywords(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_rake_scores_words_a_document_at_a_time(spark):
    """Interpreted expressions over each document's arrays took most of the time; one call ranks a document now."""
    docs = spark.createDataFrame([(1, "Red fox, don't the red-hot lazy dog; naïve façade 東京 42!"), (2, "b k. k b"),
                                  (3, "one two, three"), (3, "x, y z")], "docno int, text string")
    kws = kw.rake_keywords(docs, max_keywords=4)
    plan = kws._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "by_word" not in plan
    got = {}
    for r in kws.orderBy("docno", "kw_rank").collect():
        got.setdefault(r.docno, []).append(r.keyword)
    assert got[2] == ["k", "b"]                      # equal scores: the larger phrase first
    # the n-th phrases of an id's texts count as one: "one x two" 5, "three y z" 5
    assert got[3] == ["three", "y", "z", "one"]
    assert got[1] == ["naïve", "façade", "東京", "42"]


def test_rounding_is_that_of_spark(spark):
    values = [2.0000005, 0.0078125, 1 / 3, 4.5, 1e12 / 7, 2.6666665, 7.0000004999999, 123456.1234565]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", F.round("x", 6).alias("r")).collect()
    assert [kw._rounded(r.x) for r in rows] == [r.r for r in rows]


def test_vectors_are_learned_from_all_documents(spark):
    """A word that only documents of the largest hashes hold has a vector, beyond 20,000 documents, too."""
    docs = spark.range(21_500).select(F.col("id").alias("docno"), F.xxhash64("id").alias("h"))
    last = docs.agg(F.percentile_approx("h", 0.98)).first()[0]
    docs = docs.select("docno", F.when(F.col("h") > last, "gamma alpha").otherwise("alpha beta").alias("text")).repartition(4)
    terms, vectors = kw.learned_vectors(docs, dims=4)
    assert {r.term for r in terms.collect()} == {"alpha", "beta", "gamma"}
    assert vectors.count() == 21_500
    got = kw.keywords_extractor(docs, method="bert")
    assert got.filter("keyword = 'gamma'").count() == docs.filter("text like 'gamma%'").count() > 100
