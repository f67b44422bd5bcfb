import unicodedata

from pyspark.sql import functions as F

from quarry.functions import ENGLISH_STOP_WORDS, clean_question, count_words, tokens

HOSTILE = [None, "", "!!!...", "Hello！World", "a b", "x\t\t\ny", "p\x1cq", "  lead and trail  ",
           "full　width", "Ｆｕｌｌ ｗｉｄｔｈ", "tab\x0bvt", "mixed line para", "ok"]


def test_stop_list_is_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert tuple(StopWordsRemover.loadDefaultStopWords("english")) == ENGLISH_STOP_WORDS


def test_clean_question_hostile(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(HOSTILE)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_question(F.col("t")).alias("c")).collect()}
    expected = {
        0: "", 1: "", 2: "",
        3: "Hello World",          # NFKC turns the full-width ! into ASCII, then removed
        4: "a b",                  # no-break space -> space
        5: "x y", 6: "p q",        # runs of space incl. \x1c collapse to one
        7: "lead and trail", 8: "full width", 9: "Full width", 10: "tab vt",
        11: "mixed line para", 12: "ok",
    }
    assert got == expected


def test_count_words_matches_python_split(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(HOSTILE)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", count_words(F.col("t")).alias("n")).collect()}
    assert got == {i: (len(v.split()) if v is not None else 0) for i, v in enumerate(HOSTILE)}


def test_tokens_lowercase_letters_digits_and_stop_list(spark):
    df = spark.createDataFrame([("The Quick-brown fox, 42 times; l'été!",)], "t string")
    r = df.select(tokens(F.col("t")).alias("a"), tokens(F.col("t"), None).alias("b")).first()
    assert r.b == ["the", "quick", "brown", "fox", "42", "times", "l", "été"]
    assert r.a == ["quick", "brown", "fox", "42", "times", "l", "été"]


def test_nfkc_udf(spark):
    from quarry.functions import nfkc
    s = "ﬁ ① Ａ"
    r = spark.createDataFrame([(s,)], "t string").select(nfkc(F.col("t")).alias("n")).first()
    assert r.n == unicodedata.normalize("NFKC", s)


def test_porter_examples_and_column(spark):
    from quarry.functions.stem import porter_stem
    cases = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "motoring": "motor",
             "hopping": "hop", "filing": "file", "relational": "relat", "generalizations": "gener",
             "oscillators": "oscil", "effective": "effect", "controll": "control", "sky": "sky"}
    assert {w: porter_stem(w) for w in cases} == cases
    r = spark.createDataFrame([("The ponies were hopping",)], "t string") \
        .select(tokens(F.col("t"), stem=True).alias("a")).first()
    assert r.a == ["poni", "hop"]


def test_stemmed_index_matches_stemmed_queries(spark):
    from quarry.operators import index as ix
    from quarry.operators import retrieve as rt
    from quarry.session import scratch_path
    docs = spark.createDataFrame([(1, "connected connections"), (2, "connect")], "docno long, text string")
    idx = ix.build_index(docs, scratch_path(spark, "stem-idx"), doc_buckets=2, stem=True)
    assert idx.stemmed and {r.term for r in ix.lexicon(idx).collect()} == {"connect"}
    topics = spark.createDataFrame([(7, "connecting")], "qid long, query string")
    run = rt.bm25(idx, rt.query_terms(topics, index=idx)).collect()
    assert sorted(r.docno for r in run) == [1, 2]
