"""

Each query reads the driver's tables below ``sf_dir`` (or data Spark
derives from them, such as an index built from ``documents``) and returns
a DataFrame.  The SQL next to it is the DuckDB oracle over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import evaluate as ev
from quarry.operators import index as ix
from quarry.operators import retrieve as rt
from quarry.plans import indexes
from quarry.plans import oracle as O
from quarry.plans.registry import query
from quarry.operators.util import top_k
from quarry.sources import tables

DEPTH = 1000          # the retrievers' default depth
CROSS_DEPTH = 100     # cross-encoder re-rank depth (experiment 6)


def _qterms(spark, sf_dir, index=None):
    return rt.query_terms(tables.topics(spark, sf_dir), index or indexes.basic_index(spark, sf_dir))


def _bm25_run(spark, sf_dir, k=DEPTH):
    return rt.bm25(indexes.basic_index(spark, sf_dir), _qterms(spark, sf_dir), k=k)


# --------------------------------------------------------------- collection
@query("corpus_load", O.with_(O.corpus_cte()) + " SELECT docno, text FROM corpus")
def corpus_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.corpus(spark, sf_dir)


@query("topics_clean", O.with_(O.topics_cte()) + " SELECT qid, query FROM topics")
def topics_clean(spark, sf_dir):
    return tables.topics(spark, sf_dir)


@query("qrels_build", O.with_(O.qrels_cte()) + " SELECT qid, iteration, docno, relevance FROM qrels")
def qrels_build(spark, sf_dir):
    return tables.qrels(spark, sf_dir).select("qid", "iteration", "docno", "relevance")


# -------------------------------------------------------------------- index
@query("postings", O.with_(O.corpus_cte(), O.index_ctes())
       + " SELECT docno, term, tf, dl FROM post")
def postings(spark, sf_dir):
    return indexes.basic_index(spark, sf_dir).postings.select("docno", "term", "tf", "dl")


@query("lexicon", O.with_(O.corpus_cte(), O.index_ctes()) + " SELECT term, df, cf FROM lex")
def lexicon(spark, sf_dir):
    return ix.lexicon(indexes.basic_index(spark, sf_dir))


@query("collection_stats", O.with_(O.corpus_cte(), O.index_ctes()) + """
 SELECT CAST(n AS BIGINT) AS n_docs, (SELECT count(*) FROM lex) AS n_terms,
        CAST(tokens AS BIGINT) AS n_tokens, round(avgdl, 6) AS avgdl FROM stats""")
def collection_stats(spark, sf_dir):
    return indexes.basic_index(spark, sf_dir).stats().select("n_docs", "n_terms", "n_tokens", "avgdl")


# ---------------------------------------------------------------- retrieval
def _run_sql(model: str, k: int) -> str:
    return O.with_(O.corpus_cte(), O.topics_cte(), O.index_ctes(),
                   O.query_terms_cte("qt", "topics"), O.retrieve_ctes("run", "qt", model, k))


@query("bm25", _run_sql("BM25", DEPTH) + " SELECT qid, docno, score, rank FROM run")
def bm25(spark, sf_dir):
    return _bm25_run(spark, sf_dir)


@query("tfidf", _run_sql("TF_IDF", DEPTH) + " SELECT qid, docno, score, rank FROM run")
def tfidf(spark, sf_dir):
    return rt.tf_idf(indexes.basic_index(spark, sf_dir), _qterms(spark, sf_dir), k=DEPTH)


@query("rank_cutoff", _run_sql("BM25", DEPTH)
       + f" SELECT qid, docno, score, rank FROM run WHERE rank <= {CROSS_DEPTH}")
def rank_cutoff(spark, sf_dir):
    return rt.cutoff(_bm25_run(spark, sf_dir), CROSS_DEPTH)


@query("get_text", _run_sql("BM25", 10)
       + " SELECT r.qid, r.docno, r.rank, c.text FROM run r LEFT JOIN corpus c USING (docno)")
def get_text(spark, sf_dir):
    idx = indexes.basic_index(spark, sf_dir)
    return ix.get_text(_bm25_run(spark, sf_dir, 10), idx).select("qid", "docno", "rank", "text")


# --------------------------------------------------------------- evaluation
@query("metrics_per_query", _run_sql("BM25", DEPTH) + "," + O.metrics_ctes("run", "qrels").lstrip()
       .replace("m_q AS", O.qrels_cte().strip() + ",\nm_q AS", 1) + f"""
 SELECT i.qid, {O.metric_select()} FROM m_i i LEFT JOIN m_a USING (qid)""")
def metrics_per_query(spark, sf_dir):
    return ev.per_query(_bm25_run(spark, sf_dir), tables.qrels(spark, sf_dir),
                        tables.topics(spark, sf_dir))


# ---------------------------------------------------------- collection build
from quarry.operators import analysis as an  # noqa: E402
from quarry.operators import collection as co  # noqa: E402
from quarry.session import temporary_path  # noqa: E402
from quarry.sources import json_io  # noqa: E402

_SPLIT_COLS = "src_ord, pos, para_id, context, raw_ocr, publication_date"


def _union(spark, sf_dir):
    return co.project(co.union_splits(*tables.document_splits(spark, sf_dir)))


@query("union_splits", O.with_(O.splits_cte()) + f" SELECT {_SPLIT_COLS} FROM splits")
def union_splits(spark, sf_dir):
    return _union(spark, sf_dir).select(*_SPLIT_COLS.split(", "))


_DEDUP_SQL = O.with_(O.splits_cte()) + f"""
 SELECT {_SPLIT_COLS} FROM (
   SELECT *, row_number() OVER (PARTITION BY para_id ORDER BY src_ord, pos) AS rn
   FROM splits WHERE para_id IS NOT NULL AND para_id <> '') WHERE rn = 1"""


@query("dedup_keep_first", _DEDUP_SQL)
def dedup_keep_first(spark, sf_dir):
    return co.dedup_keep_first(_union(spark, sf_dir)).select(*_SPLIT_COLS.split(", "))


@query("collection_json_roundtrip", O.with_(O.splits_cte()) + """
 SELECT para_id AS docno, context AS text FROM (
   SELECT *, row_number() OVER (PARTITION BY para_id ORDER BY src_ord, pos) AS rn
   FROM splits WHERE para_id IS NOT NULL AND para_id <> '') WHERE rn = 1""")
def collection_json_roundtrip(spark, sf_dir):
    """A7 then A1: write the deduplicated collection as JSON lines to the
    shared folder and load it back as a corpus."""
    path = temporary_path(spark, "collection-json")
    coll = co.dedup_keep_first(_union(spark, sf_dir)).orderBy("src_ord", "pos")
    json_io.write_json(coll.select(*json_io.COLLECTION_FIELDS), path)
    return json_io.load_documents(spark, path)


@query("topics_first_n", O.with_(O.test_records_cte()) + f"""
 SELECT query_id, question FROM (
   SELECT coalesce(query_id, '') AS query_id, {O.clean('question')} AS question FROM test_records)
 ORDER BY {O.topic_order('query_id')} LIMIT {co.FIRST_TOPICS}""")
def topics_first_n(spark, sf_dir):
    """G1 + E3 + E4 on the test records: cleaned, sorted by id, first 10,000."""
    return co.build_topics(tables.test_records(spark, sf_dir))


@query("topics_first_10", O.with_(O.test_records_cte()) + f"""
 SELECT query_id, question FROM (
   SELECT coalesce(query_id, '') AS query_id, {O.clean('question')} AS question FROM test_records)
 ORDER BY {O.topic_order('query_id')} LIMIT 10""")
def topics_first_10(spark, sf_dir):
    """E4 with a cut that acts: the feature is the limit."""
    return co.build_topics(tables.test_records(spark, sf_dir), first_n=10)


@query("topics_sample_10", O.with_(O.topics_cte()) + f"""
 SELECT qid, query FROM topics
 ORDER BY md5(concat_ws('-', '{co.SEED}', CAST(qid AS VARCHAR))), qid LIMIT 10""")
def topics_sample_10(spark, sf_dir):
    """E5 with a sample smaller than the table."""
    return co.sample_topics(tables.topics(spark, sf_dir), 10, co.SEED)


@query("load_queries_json", O.with_(O.topics_cte())
       + " SELECT CAST(qid AS VARCHAR) AS qid, query, b.text AS raw FROM topics JOIN benchmark b ON b.item_id = qid")
def load_queries_json(spark, sf_dir):
    """A7 then A2: topics as JSON lines, loaded back with all their columns."""
    path = temporary_path(spark, "topics-json")
    t = tables.topics(spark, sf_dir).join(tables.raw_topics(spark, sf_dir), "qid")
    json_io.write_json(t.select(F.col("qid").alias("query_id"), F.col("query").alias("question"),
                                F.col("text").alias("raw")), path)
    return json_io.load_queries(spark, path)


@query("load_qrels_json", O.with_(O.test_records_cte())
       + " SELECT coalesce(query_id, '') AS qid, 0 AS iteration,"
         " coalesce(para_id, '') AS docno, 1 AS relevance FROM test_records")
def load_qrels_json(spark, sf_dir):
    """B3, A7, then A3: judgments as JSON lines, loaded back."""
    path = temporary_path(spark, "qrels-json")
    json_io.write_json(co.build_qrels(tables.test_records(spark, sf_dir)), path)
    return json_io.load_qrels(spark, path)


@query("topics_sample", O.with_(O.topics_cte()) + f"""
 SELECT qid, query FROM topics
 ORDER BY md5(concat_ws('-', '{co.SEED}', CAST(qid AS VARCHAR))), qid LIMIT {co.SAMPLE_SIZE}""")
def topics_sample(spark, sf_dir):
    return co.sample_topics(tables.topics(spark, sf_dir), co.SAMPLE_SIZE, co.SEED)


@query("qrels_from_records", O.with_(O.test_records_cte())
       + " SELECT coalesce(query_id, '') AS query_id, 0 AS iteration,"
         " coalesce(para_id, '') AS para_id, 1 AS relevance FROM test_records")
def qrels_from_records(spark, sf_dir):
    """B3 over the test records (all of them, no 10,000 cut)."""
    return co.build_qrels(tables.test_records(spark, sf_dir))


@query("answers_build", O.with_(O.test_records_cte())
       + " SELECT coalesce(query_id, '') AS query_id, 0 AS iteration, coalesce(para_id, '') AS para_id,"
         " 1 AS relevance, coalesce(answer, '') AS answer, coalesce(org_answer, '') AS org_answer"
         " FROM test_records")
def answers_build(spark, sf_dir):
    return co.build_answers(tables.test_records(spark, sf_dir))


@query("corpus_summary", O.with_(O.corpus_cte())
       + " SELECT docno, text, (SELECT count(*) FROM corpus) AS n_rows FROM corpus ORDER BY docno LIMIT 5")
def corpus_summary(spark, sf_dir):
    """Count plus the first five documents."""
    return co.summary(tables.corpus(spark, sf_dir), "docno", 5)


@query("query_0", O.with_(O.topics_cte()) + " SELECT qid, query, query AS query_0 FROM topics")
def query_0(spark, sf_dir):
    return co.keep_original_query(tables.topics(spark, sf_dir))


# ------------------------------------------------------------ length analysis
def _lens(spark, sf_dir):
    return an.with_lengths(tables.corpus(spark, sf_dir))


@query("max_lengths", " SELECT CAST(max(length(CAST(doc_id AS VARCHAR))) AS INTEGER) AS max_docno_len,"
                      " CAST(max(length(text)) AS INTEGER) AS max_text_len FROM documents")
def max_lengths(spark, sf_dir):
    return an.max_lengths(tables.corpus(spark, sf_dir))


def _describe_sql(col):
    return O.with_(O.lengths_cte()) + f"""
 SELECT count({col}) AS count, round(avg({col}), 6) AS mean, round(stddev_samp({col}), 6) AS std,
        round(CAST(min({col}) AS DOUBLE), 6) AS min,
        round(quantile_cont({col}, 0.25), 6) AS p25, round(quantile_cont({col}, 0.5), 6) AS p50,
        round(quantile_cont({col}, 0.75), 6) AS p75, round(CAST(max({col}) AS DOUBLE), 6) AS max
 FROM lens"""


@query("length_describe", _describe_sql("n_words"))
def length_describe(spark, sf_dir):
    return an.describe(_lens(spark, sf_dir), "n_words")


@query("token_describe", _describe_sql("n_tokens"))
def token_describe(spark, sf_dir):
    return an.describe(_lens(spark, sf_dir), "n_tokens")


@query("length_fraction", O.with_(O.lengths_cte())
       + " SELECT round(avg(CASE WHEN n_tokens <= 512 THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM lens")
def length_fraction(spark, sf_dir):
    return an.fraction_within(_lens(spark, sf_dir), "n_tokens", 512)


@query("length_histogram", O.with_(O.lengths_cte(), O.binned_cte("n_words", 50))
       + " SELECT bin, lo, hi, count FROM h")
def length_histogram(spark, sf_dir):
    return an.histogram(_lens(spark, sf_dir), "n_words", 50)


@query("length_cumulative", O.with_(O.lengths_cte(), O.binned_cte("n_words", 100))
       + " SELECT bin, lo, hi, round(sum(count) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING"
         " AND CURRENT ROW) * 100.0 / sum(count) OVER (), 6) AS cum_pct FROM h")
def length_cumulative(spark, sf_dir):
    return an.cumulative(_lens(spark, sf_dir), "n_words", 100)


# ------------------------------------------------------------------ keywords
from quarry.operators import keywords as kw  # noqa: E402
from quarry.sources import thesaurus as th  # noqa: E402


@query("rake_keywords", O.with_(O.corpus_cte(), O.rake_ctes("corpus"))
       + " SELECT docno, kw_rank, keyword FROM rk")
def rake_keywords(spark, sf_dir):
    return kw.rake_keywords(tables.corpus(spark, sf_dir))


@query("similarity_keywords", None)
def similarity_keywords(spark, sf_dir):
    """Keywords of every document by similarity to its vector, both learned from the documents.
    SQL has no such training; tests hold the ranking against numpy."""
    return kw.keywords_extractor(tables.corpus(spark, sf_dir), method="bert")


@query("thesaurus_expand", O.with_(O.corpus_cte(), O.rake_ctes("corpus"), O.thesaurus_ctes("corpus", "rk"))
       + " SELECT docno, kw_rank, keyword, array_to_string(synonyms, '|') AS synonyms FROM th")
def thesaurus_expand(spark, sf_dir):
    d = tables.corpus(spark, sf_dir)
    e = kw.thesaurus_expansion(d, kw.rake_keywords(d), th.fixture(spark))
    return e.withColumn("synonyms", F.array_join("synonyms", "|"))


_TOPIC_SRC = "tsrc AS (SELECT qid AS docno, query AS text FROM topics)"


@query("query_expand", O.with_(O.topics_cte(), _TOPIC_SRC, O.rake_ctes("tsrc"), O.thesaurus_ctes("tsrc", "rk"))
       + " SELECT t.qid, concat_ws(' ', t.query, e.expansion) AS query, t.query AS query_0"
         " FROM topics t JOIN th_e e ON e.docno = t.qid")
def query_expand(spark, sf_dir):
    return kw.expand_queries(tables.topics(spark, sf_dir), th.fixture(spark))


@query("doc_expand", O.with_(O.corpus_cte(), O.rake_ctes("corpus"), O.thesaurus_ctes("corpus", "rk"))
       + " SELECT docno, expansion AS text FROM th_e")
def doc_expand(spark, sf_dir):
    return kw.expand_documents(tables.corpus(spark, sf_dir), th.fixture(spark), replace=True)


# ------------------------------------------- expanded queries, keyword index
def _expanded_topics(spark, sf_dir):
    return kw.expand_queries(tables.topics(spark, sf_dir), th.fixture(spark))


_EXP_TOPICS = [O.topics_cte(), _TOPIC_SRC, O.rake_ctes("tsrc", "qk"), O.thesaurus_ctes("tsrc", "qk", "qth"),
               "xtopics AS (SELECT t.qid, concat_ws(' ', t.query, e.expansion) AS query"
               " FROM topics t JOIN qth_e e ON e.docno = t.qid)"]
_KW_DOCS = [O.corpus_cte(), O.rake_ctes("corpus"), O.thesaurus_ctes("corpus", "rk"),
            "kdocs AS (SELECT docno, expansion AS text FROM th_e)"]


@query("bm25_expanded_queries", O.with_(O.corpus_cte(), *_EXP_TOPICS, O.index_ctes(),
                                        O.query_terms_cte("qt", "xtopics"), O.retrieve_ctes("run", "qt", "BM25", DEPTH))
       + " SELECT qid, docno, score, rank FROM run")
def bm25_expanded_queries(spark, sf_dir):
    """Experiment 2: BM25 with thesaurus-expanded queries (G9 + H1)."""
    idx = indexes.basic_index(spark, sf_dir)
    return rt.bm25(idx, rt.query_terms(_expanded_topics(spark, sf_dir), idx), k=DEPTH)


@query("keyword_index_bm25", O.with_(*_KW_DOCS, O.topics_cte(), O.index_ctes("kdocs"),
                                     O.query_terms_cte("qt", "topics"), O.retrieve_ctes("run", "qt", "BM25", DEPTH))
       + " SELECT qid, docno, score, rank FROM run")
def keyword_index_bm25(spark, sf_dir):
    """Experiment 3A: BM25 on the keyword-only index."""
    idx = indexes.keywords_index(spark, sf_dir)
    return rt.bm25(idx, _qterms(spark, sf_dir, idx), k=DEPTH)


@query("keyword_index_bm25_expanded", O.with_(*_KW_DOCS, *_EXP_TOPICS[1:], O.index_ctes("kdocs"),
                                              O.query_terms_cte("qt", "xtopics"),
                                              O.retrieve_ctes("run", "qt", "BM25", DEPTH))
       .replace("WITH corpus AS", "WITH " + O.topics_cte() + ",\ncorpus AS", 1)
       + " SELECT qid, docno, score, rank FROM run")
def keyword_index_bm25_expanded(spark, sf_dir):
    """Experiment 3B: keyword-only index with expanded queries."""
    idx = indexes.keywords_index(spark, sf_dir)
    return rt.bm25(idx, rt.query_terms(_expanded_topics(spark, sf_dir), idx), k=DEPTH)


# -------------------------------------------------------------------- BM25F
_FIELDED = [O.corpus_cte(), O.rake_ctes("corpus"), O.thesaurus_ctes("corpus", "rk"), O.topics_cte(),
            O.fielded_index_ctes([("corpus", "text"), ("th_e", "expansion")]), O.query_terms_cte("qt", "topics")]


def _bm25f(weights):
    def run(spark, sf_dir):
        idx = indexes.two_fields_index(spark, sf_dir)
        return rt.bm25f(idx, _qterms(spark, sf_dir, idx), weights, k=DEPTH)
    return run


for _name, _w in (("bm25f_keywords", (0.0, 1.0)), ("bm25f_text", (1.0, 0.0)), ("bm25f_mixed", (0.7, 0.3))):
    query(_name, O.with_(*_FIELDED, O.bm25f_ctes("run", "qt", _w, DEPTH))
          + " SELECT qid, docno, score, rank FROM run")(_bm25f(_w))


# ---------------------------------------------------------------------- RM3
def _rm3_sql(model, final):
    base = [O.corpus_cte(), O.topics_cte(), O.index_ctes(), O.query_terms_cte("qt", "topics"),
            O.retrieve_ctes("r1", "qt", model, DEPTH), O.rm3_ctes("qt2", "r1", "qt")]
    if final == "terms":
        return O.with_(*base) + " SELECT qid, term, weight FROM qt2"
    return O.with_(*base, O.retrieve_ctes("run", "qt2", model, DEPTH)) + " SELECT qid, docno, score, rank FROM run"


@query("rm3_terms", _rm3_sql("BM25", "terms"))
def rm3_terms(spark, sf_dir):
    idx = indexes.basic_index(spark, sf_dir)
    qt = _qterms(spark, sf_dir)
    return rt.rm3_terms(idx, rt.bm25(idx, qt, k=DEPTH), qt)


@query("rm3_bm25", _rm3_sql("BM25", "run"))
def rm3_bm25(spark, sf_dir):
    return rt.rm3(indexes.basic_index(spark, sf_dir), _qterms(spark, sf_dir), "BM25", DEPTH)


@query("rm3_tfidf", _rm3_sql("TF_IDF", "run"))
def rm3_tfidf(spark, sf_dir):
    return rt.rm3(indexes.basic_index(spark, sf_dir), _qterms(spark, sf_dir), "TF_IDF", DEPTH)


# -------------------------------------------------------------------- dense
from quarry.operators import dense as de  # noqa: E402

_VEC_CTE = "vecs AS (SELECT vec_id AS docno, embedding AS vec, label FROM embeddings)"


def _vectors(spark, sf_dir):
    return tables.vectors(spark, sf_dir).select(F.col("vec_id").alias("docno"),
                                                F.col("embedding").alias("vec"), "label")


_QV_CTE = "qv AS (SELECT docno AS qid, vec FROM vecs)"


def _asking(v):
    """Every vector asks, all answer."""
    return v.withColumnRenamed("docno", "qid")


@query("dense_topk", O.with_(_VEC_CTE, _QV_CTE, O.dense_topk_ctes("run", "vecs", "qv", de.DEPTH))
       + " SELECT qid, docno, score, rank FROM run")
def dense_topk(spark, sf_dir):
    """H7: every vector queries the whole vector table (top 1000)."""
    v = _vectors(spark, sf_dir)
    return de.exhaustive_topk(v, _asking(v), de.DEPTH)


@query("dense_label_metrics", O.with_(_VEC_CTE, _QV_CTE, O.dense_topk_ctes("run", "vecs", "qv", de.DEPTH),
                                      "ql AS (SELECT docno AS qid, label FROM vecs)",
                                      O.label_metrics_ctes("run", "vecs", "ql"))
       + f" SELECT i.qid, {O.metric_select()} FROM lm_i i LEFT JOIN lm_a USING (qid)")
def dense_label_metrics(spark, sf_dir):
    """Dense run scored with same-label relevance (judgments never built)."""
    v = _vectors(spark, sf_dir)
    ql = _asking(v)
    run = de.exhaustive_topk(v, ql, de.DEPTH)
    ql = ql.select("qid", "label")
    return ev.metrics_from_hits(ev.label_hits(run, v, ql), ev.label_ideal(v, ql))


_DV_CTE = O.hashed_vectors_ctes("dv", "corpus", "docno", "post", "tf")
_TV_CTE = O.hashed_vectors_ctes("tv", "topics", "qid", "qt", "weight")
_ENCODED = [O.corpus_cte(), O.topics_cte(), O.index_ctes(), O.query_terms_cte("qt", "topics"), _DV_CTE, _TV_CTE]


@query("dense_encode", O.with_(*_ENCODED) + """,
e AS (SELECT 'document' AS kind, docno AS id, generate_subscripts(vec, 1) - 1 AS dim, unnest(vec) AS x FROM dv
      UNION ALL SELECT 'query', qid, generate_subscripts(vec, 1) - 1, unnest(vec) FROM tv)
 SELECT kind, id, CAST(dim AS INTEGER) AS dim, x FROM e WHERE x <> 0""")
def dense_encode(spark, sf_dir):
    """H6: hashed vectors of all documents and topics, one row per place that is not zero."""
    idx = indexes.basic_index(spark, sf_dir)
    d = de.document_vectors(idx).withColumnRenamed("docno", "id").withColumn("kind", F.lit("document"))
    q = de.query_vectors(tables.topics(spark, sf_dir), idx).withColumnRenamed("qid", "id").withColumn("kind", F.lit("query"))
    return (d.unionByName(q).select("kind", "id", F.posexplode("vec").alias("dim", "x"))
            .filter("x <> 0"))


@query("dense_index_search", O.with_(*_ENCODED, O.dense_topk_ctes("run", "dv", "tv", 100))
       + " SELECT qid, docno, score, rank FROM run")
def dense_index_search(spark, sf_dir):
    """Every document encoded and stored, opened, and searched by every topic (top 100)."""
    idx = indexes.basic_index(spark, sf_dir)
    return de.exhaustive_topk(indexes.dense_index(spark, sf_dir), de.query_vectors(tables.topics(spark, sf_dir), idx), 100)


def _rescored(name: str, run: str) -> str:
    return f"""{name}_s AS (SELECT r.qid, r.docno, round(list_sum(list_transform(list_zip(q.vec, d.vec),
          lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score
       FROM {run} r LEFT JOIN dv d ON d.docno = r.docno LEFT JOIN tv q ON q.qid = r.qid),
{name} AS (SELECT qid, docno, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS INTEGER) AS rank
       FROM {name}_s)"""


@query("dense_rerank", O.with_(*_ENCODED, O.retrieve_ctes("r1", "qt", "BM25", DEPTH), _rescored("rr", "r1"))
       + " SELECT qid, docno, score, rank FROM rr")
def dense_rerank(spark, sf_dir):
    """H8: BM25 top 1000 re-scored by the dot product of the vectors of
    document and topic; every document has one, so no row is lost."""
    idx = indexes.basic_index(spark, sf_dir)
    return de.rerank(_bm25_run(spark, sf_dir), indexes.dense_index(spark, sf_dir),
                     de.query_vectors(tables.topics(spark, sf_dir), idx))


# ------------------------------------------------- passages, re-rank, answers
from quarry.operators import answer as an_  # noqa: E402
from quarry.operators import rerank as rr  # noqa: E402


def _top_text(spark, sf_dir, topics, k=CROSS_DEPTH):
    idx = indexes.basic_index(spark, sf_dir)
    run = rt.bm25(idx, rt.query_terms(topics, idx), k=k)
    return idx, ix.get_text(run, idx).select("qid", "docno", "rank", "text")


def _first_stage_sql(topics_cte: str, topics: str, k: int = CROSS_DEPTH) -> list[str]:
    return [O.corpus_cte(), topics_cte, O.index_ctes(), O.query_terms_cte("qt", topics),
            O.retrieve_ctes("r1", "qt", "BM25", k),
            "rt AS (SELECT r.qid, r.docno, r.rank, c.text FROM r1 r LEFT JOIN corpus c USING (docno))"]


@query("passages", O.with_(*_first_stage_sql(O.topics_cte(), "topics"), O.passages_ctes("rt"))
       + " SELECT qid, docno, rank, passage_no, text FROM passages")
def passages(spark, sf_dir):
    """G11 on the BM25 top 100: windows of 256 tokens, stride 128."""
    idx = indexes.basic_index(spark, sf_dir)
    run = rt.bm25(idx, rt.query_terms(tables.topics(spark, sf_dir), idx), k=CROSS_DEPTH)
    return rr.run_passages(run, idx, with_terms=False).select("qid", "docno", "rank", "passage_no", "text")


@query("pair_rerank", O.with_(*_first_stage_sql(O.topics_cte(), "topics"),
                              O.coverage_ctes("rt", "topics", "qid, docno, rank"))
       + " SELECT qid, docno, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS INTEGER) AS rank"
         " FROM cov")
def pair_rerank(spark, sf_dir):
    """H9 (experiment 6): BM25 top 100 re-scored by the pair scorer over
    whole documents (default stand-in scorer)."""
    t = tables.topics(spark, sf_dir)
    idx, run = _top_text(spark, sf_dir, t)
    scored = rr.coverage_scores(run, t, idx).drop("rank")
    return top_k(scored, None).select("qid", "docno", "score", "rank")


_MAXP_SQL = [*_first_stage_sql(O.topics_cte(), "topics"), O.passages_ctes("rt"),
             O.coverage_ctes("passages", "topics", "qid, docno, rank, passage_no"), O.max_passage_ctes("cov")]


@query("max_passage", O.with_(*_MAXP_SQL) + " SELECT qid, docno, score, text, rank FROM mp")
def max_passage(spark, sf_dir):
    """BM25 % 100 -> text -> passages -> pair scorer -> max passage."""
    t = tables.topics(spark, sf_dir)
    idx = indexes.basic_index(spark, sf_dir)
    run = rt.bm25(idx, rt.query_terms(t, idx), k=CROSS_DEPTH)
    return rr.max_passage(rr.coverage_scores(rr.run_passages(run, idx), t, idx))


_QA_SQL = [*_first_stage_sql(O.questions_cte(), "questions"), O.passages_ctes("rt"),
           O.coverage_ctes("passages", "questions", "qid, docno, rank, passage_no"),
           O.max_passage_ctes("cov"), O.context_cte("mp")]


def _qa_context(spark, sf_dir):
    q = tables.questions(spark, sf_dir)
    idx = indexes.basic_index(spark, sf_dir)
    run = rt.bm25(idx, rt.query_terms(q, idx), k=CROSS_DEPTH)
    return q, an_.context(rr.top_passages(run, q, idx, an_.CONTEXT_DOCS), an_.CONTEXT_DOCS)


@query("context", O.with_(*_QA_SQL) + " SELECT qid, context FROM ctx")
def context(spark, sf_dir):
    """I1/I2 for every user question of ``conversations``."""
    return _qa_context(spark, sf_dir)[1]


def _flat(prompts):
    return prompts.select("qid", F.posexplode("messages").alias("msg_no", "m")) \
        .select("qid", "msg_no", "m.role", "m.content")


@query("prompts_tool", O.with_(*_QA_SQL) + f""",
pr AS (SELECT q.qid, [{{'role': 'system', 'content': {O.lit_str(an_.SYSTEM_PROMPT_TOOL)}}},
                     {{'role': 'tool', 'content': coalesce(c.context, '')}},
                     {{'role': 'user', 'content': q.query}}] AS messages
       FROM questions q LEFT JOIN ctx c USING (qid))
 SELECT qid, CAST(generate_subscripts(messages, 1) - 1 AS INTEGER) AS msg_no,
        unnest(messages).role AS role, unnest(messages).content AS content FROM pr""")
def prompts_tool(spark, sf_dir):
    """I3, one row per message ``(qid, msg_no, role, content)``."""
    q, ctx = _qa_context(spark, sf_dir)
    return _flat(an_.prompts_tool(q, ctx))


@query("prompts_user", O.with_(*_QA_SQL) + f""",
pr AS (SELECT q.qid, [{{'role': 'system', 'content': {O.lit_str(an_.SYSTEM_PROMPT_USER)}}},
                     {{'role': 'user', 'content': coalesce(c.context, '') || chr(10) || chr(10) || q.query}}] AS messages
       FROM questions q LEFT JOIN ctx c USING (qid))
 SELECT qid, CAST(generate_subscripts(messages, 1) - 1 AS INTEGER) AS msg_no,
        unnest(messages).role AS role, unnest(messages).content AS content FROM pr""")
def prompts_user(spark, sf_dir):
    """I4, one row per message."""
    q, ctx = _qa_context(spark, sf_dir)
    return _flat(an_.prompts_user(q, ctx))


@query("answers", O.with_(*_QA_SQL) + """,
aa AS (SELECT q.qid, coalesce(c.context, '') AS context,
              CASE WHEN len(string_split(coalesce(c.context, ''), chr(10) || chr(10))) > 2
                   THEN string_split(c.context, chr(10) || chr(10))[2] ELSE '' END AS answer
       FROM questions q LEFT JOIN ctx c USING (qid))
 SELECT qid, answer || chr(10) || chr(10) || context AS answer FROM aa""")
def answers(spark, sf_dir):
    """I5 + I6 with the stand-in answer function (first context passage)."""
    q, ctx = _qa_context(spark, sf_dir)
    return an_.final_answers(an_.generate(an_.prompts_tool(q, ctx)))


# --------------------------------------------------------------- experiments
from quarry.plans import experiments as xp  # noqa: E402
from quarry.sources import runs as runs_io  # noqa: E402


def _exp_sql(ctes: list[str], runs: list[tuple[str, str]], **kw) -> str:
    mt, final = O.metrics_table_sql(runs, **kw)
    return O.with_(*ctes, O.qrels_cte(), mt) + final


def _lit(name):
    return O.lit_str(name)


_BASE = [O.corpus_cte(), O.topics_cte(), O.index_ctes(), O.query_terms_cte("qt", "topics")]


def _four_sql(qt: str):
    return [O.retrieve_ctes("rb", qt, "BM25", DEPTH), O.rm3_ctes("qb", "rb", qt),
            O.retrieve_ctes("rbr", "qb", "BM25", DEPTH),
            O.retrieve_ctes("rt", qt, "TF_IDF", DEPTH), O.rm3_ctes("qtf", "rt", qt),
            O.retrieve_ctes("rtr", "qtf", "TF_IDF", DEPTH)]


def _four_runs(prefix, suffix=lambda s: _lit(s)):
    return [(suffix(f"{prefix}_bm25"), "rb"), (suffix(f"{prefix}_bm25_rm3"), "rbr"),
            (suffix(f"{prefix}_tfidf"), "rt"), (suffix(f"{prefix}_tfidf_rm3"), "rtr")]


@query("exp0", _exp_sql(_BASE + [O.retrieve_ctes("rt", "qt", "TF_IDF", DEPTH), O.retrieve_ctes("rb", "qt", "BM25", DEPTH),
                                  O.rm3_ctes("qb", "rb", "qt"), O.retrieve_ctes("rbr", "qb", "BM25", DEPTH)],
                        [(_lit("TF_IDF"), "rt"), (_lit("BM25"), "rb"), (_lit("BM25_RM3"), "rbr")],
                        cols=("ap_1000", "p_5", "p_10"), map_name="ap_1000"))
def exp0(spark, sf_dir):
    return xp.experiment_0(indexes.basic_index(spark, sf_dir), tables.topics(spark, sf_dir),
                           tables.qrels(spark, sf_dir))


@query("exp1", _exp_sql(_BASE + _four_sql("qt"), _four_runs("experiment1")))
def exp1(spark, sf_dir):
    return xp.experiment_1(indexes.basic_index(spark, sf_dir), tables.topics(spark, sf_dir),
                           tables.qrels(spark, sf_dir))


_SAMPLE = (f"stopics AS (SELECT * FROM topics ORDER BY md5(concat_ws('-', '{co.SEED}', CAST(qid AS VARCHAR))), qid"
           f" LIMIT {co.SAMPLE_SIZE})")


@query("exp1_sample", _exp_sql([O.corpus_cte(), O.topics_cte(), _SAMPLE, O.index_ctes(),
                                 O.query_terms_cte("qt", "stopics")] + _four_sql("qt"),
                                _four_runs("experiment1", lambda s: f"'{s}_sample_' || (SELECT count(*) FROM stopics)"
                                                                    " || '_queries'"),
                                topics="stopics"))
def exp1_sample(spark, sf_dir):
    """Experiment 1 on a seeded sample of 1,000 topics (names carry the size)."""
    return xp.experiment_1(indexes.basic_index(spark, sf_dir), tables.topics(spark, sf_dir),
                           tables.qrels(spark, sf_dir), sample=co.SAMPLE_SIZE)


@query("exp2", _exp_sql([O.corpus_cte(), *_EXP_TOPICS, O.index_ctes(), O.query_terms_cte("qt", "xtopics")]
                        + _four_sql("qt"), _four_runs("experiment2")))
def exp2(spark, sf_dir):
    return xp.experiment_2(indexes.basic_index(spark, sf_dir), tables.topics(spark, sf_dir),
                           tables.qrels(spark, sf_dir), th.fixture(spark))


_KIDX = [*_KW_DOCS, *_EXP_TOPICS, O.index_ctes("kdocs", prefix="k"),
         O.query_terms_cte("qa", "topics"), O.query_terms_cte("qx", "xtopics"),
         O.retrieve_ctes("ka", "qa", "BM25", DEPTH, prefix="k"), O.rm3_ctes("kqa", "ka", "qa", prefix="k"),
         O.retrieve_ctes("kar", "kqa", "BM25", DEPTH, prefix="k"),
         O.retrieve_ctes("kb", "qx", "BM25", DEPTH, prefix="k"), O.rm3_ctes("kqb", "kb", "qx", prefix="k"),
         O.retrieve_ctes("kbr", "kqb", "BM25", DEPTH, prefix="k")]


@query("exp3", _exp_sql(_KIDX, [(_lit("experiment3A_bm25"), "ka"), (_lit("experiment3A_bm25_rm3"), "kar"),
                                (_lit("experiment3B_bm25"), "kb"), (_lit("experiment3B_bm25_rm3"), "kbr")]))
def exp3(spark, sf_dir):
    return xp.experiment_3(indexes.keywords_index(spark, sf_dir), tables.topics(spark, sf_dir),
                           tables.qrels(spark, sf_dir), th.fixture(spark))


@query("exp4", _exp_sql(_FIELDED + [O.bm25f_ctes(f"f{i}", "qt", w, DEPTH) for i, (_, w) in enumerate(xp.BM25F_SETTINGS)],
                        [(_lit(f"experiment4_{n}"), f"f{i}") for i, (n, _) in enumerate(xp.BM25F_SETTINGS)]))
def exp4(spark, sf_dir):
    return xp.experiment_4(indexes.two_fields_index(spark, sf_dir), tables.topics(spark, sf_dir),
                           tables.qrels(spark, sf_dir))


_E5 = _BASE + [_DV_CTE, _TV_CTE, O.dense_topk_ctes("dn", "dv", "tv", DEPTH),
               O.retrieve_ctes("rb", "qt", "BM25", DEPTH), _rescored("rr", "rb")]


@query("exp5", _exp_sql(_E5, [(_lit("experiment5_biencoder"), "dn"), (_lit("experiment5_bm25_biencoder"), "rr")]))
def exp5(spark, sf_dir):
    idx, t = indexes.basic_index(spark, sf_dir), tables.topics(spark, sf_dir)
    return xp.experiment_5(idx, indexes.dense_index(spark, sf_dir), de.query_vectors(t, idx), t,
                           tables.qrels(spark, sf_dir))


@query("exp6", _exp_sql(_first_stage_sql(O.topics_cte(), "topics")
                        + [O.coverage_ctes("rt", "topics", "qid, docno, rank"),
                           "r6 AS (SELECT qid, docno, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC,"
                           " docno) AS rank FROM cov)"],
                        [(_lit("experiment6_bm25_monoT5"), "r6")]))
def exp6(spark, sf_dir):
    """J6 with the coverage stand-in for the cross-encoder."""
    return xp.experiment_6(indexes.basic_index(spark, sf_dir), tables.topics(spark, sf_dir),
                           tables.qrels(spark, sf_dir))


@query("metrics_table", _exp_sql(_BASE + [O.retrieve_ctes("rb", "qt", "BM25", DEPTH),
                                          O.retrieve_ctes("rt", "qt", "TF_IDF", DEPTH)],
                                 [(_lit("bm25"), "rb"), (_lit("tfidf"), "rt")]))
def metrics_table(spark, sf_dir):
    """D16 for two named runs."""
    idx, qt = indexes.basic_index(spark, sf_dir), _qterms(spark, sf_dir)
    runs = (rt.bm25(idx, qt, DEPTH).withColumn("name", F.lit("bm25"))
            .unionByName(rt.tf_idf(idx, qt, DEPTH).withColumn("name", F.lit("tfidf"))))
    return ev.metrics_table(runs, tables.qrels(spark, sf_dir), tables.topics(spark, sf_dir),
                            names=["bm25", "tfidf"])


@query("metrics_table_empty_system", _exp_sql(
    _BASE + [O.retrieve_ctes("rb", "qt", "BM25", DEPTH), "r0 AS (SELECT * FROM rb WHERE rank < 0)"],
    [(_lit("bm25"), "rb"), (_lit("nothing"), "r0")]).replace(
        "(SELECT DISTINCT name FROM allruns)", "(SELECT unnest(['bm25', 'nothing']) AS name)"))
def metrics_table_empty_system(spark, sf_dir):
    """D16 where one named system finds nothing: a row of zeros."""
    idx, qt = indexes.basic_index(spark, sf_dir), _qterms(spark, sf_dir)
    run = rt.bm25(idx, qt, DEPTH)
    return xp.evaluate_systems([("bm25", lambda: run), ("nothing", lambda: run.filter("rank < 0"))],
                               tables.qrels(spark, sf_dir), tables.topics(spark, sf_dir))


def _half_sql(part: str, rest: int) -> str:
    ctes = [O.corpus_cte(), O.topics_cte(), f"half AS (SELECT * FROM topics WHERE qid % 2 = {rest})", O.index_ctes(),
            O.query_terms_cte("qt", "half"), O.retrieve_ctes("rb", "qt", "BM25", DEPTH)]
    return f"SELECT '{part}' AS part, * FROM ({_exp_sql(ctes, [(_lit('bm25'), 'rb')], topics='half')})"


@query("run_reuse_two_topic_sets", " UNION ALL ".join([_half_sql("even", 0), _half_sql("odd", 1), _half_sql("even again", 0)]))
def run_reuse_two_topic_sets(spark, sf_dir):
    """Both halves of the topics with one folder for saved runs; the third
    call reads what the first saved, the second must not."""
    idx, qrels, save = indexes.basic_index(spark, sf_dir), tables.qrels(spark, sf_dir), temporary_path(spark, "saved-runs")
    out = None
    for part, rest in (("even", 0), ("odd", 1), ("even again", 0)):
        t = tables.topics(spark, sf_dir).filter(F.pmod("qid", F.lit(2)) == rest)
        qt = rt.query_terms(t, idx)
        table = xp.evaluate_systems([("bm25", lambda qt=qt: rt.bm25(idx, qt, DEPTH))], qrels, t, save,
                                    xp._params(save, idx, t)).select(F.lit(part).alias("part"), "*")
        out = table if out is None else out.unionByName(table)
    return out


@query("run_trec_roundtrip", _run_sql("BM25", DEPTH) + " SELECT qid, docno, rank, score FROM run")
def run_trec_roundtrip(spark, sf_dir):
    """A8 + A9: save the BM25 run as TREC text, then reuse it from disk."""
    path = temporary_path(spark, "runs") + "/bm25"
    run = runs_io.reuse(spark, path, lambda: _bm25_run(spark, sf_dir), "BM25",
                        qid_type="bigint", docno_type="bigint")
    return run.select("qid", "docno", "rank", "score")


@query("row_counts", O.with_(O.corpus_cte(), O.topics_cte(), O.qrels_cte()) + """
 SELECT 'documents' AS name, count(*) AS n FROM corpus
 UNION ALL SELECT 'topics', count(*) FROM topics
 UNION ALL SELECT 'qrels', count(*) FROM qrels""")
def row_counts(spark, sf_dir):
    """Row counts of documents, topics and judgments."""
    parts = [("documents", tables.corpus(spark, sf_dir)), ("topics", tables.topics(spark, sf_dir)),
             ("qrels", tables.qrels(spark, sf_dir))]
    out = None
    for name, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


# ------------------------------------------- cases that the plain tables never reach
_GRADED = (O.qrels_cte("flat") + ",\ngraded AS (SELECT qid, docno, iteration, CAST(1 + docno % 3 AS INTEGER) AS relevance FROM flat)")


@query("metrics_graded", O.with_(O.corpus_cte(), O.topics_cte(), O.index_ctes(), O.query_terms_cte("qt", "topics"),
                                 O.retrieve_ctes("run", "qt", "BM25", DEPTH), _GRADED, O.metrics_ctes("run", "graded"))
       + f" SELECT i.qid, {O.metric_select()} FROM m_i i LEFT JOIN m_a USING (qid)")
def metrics_graded(spark, sf_dir):
    """Judgments of grades 1 to 3 (by document id), so gains and ideals differ from hits."""
    graded = tables.qrels(spark, sf_dir).withColumn("relevance", (1 + F.col("docno") % 3).cast("int"))
    return ev.per_query(_bm25_run(spark, sf_dir), graded, tables.topics(spark, sf_dir))


@query("ap_below_run_depth", O.with_(O.corpus_cte(), O.topics_cte(), O.index_ctes(), O.query_terms_cte("qt", "topics"),
                                     O.retrieve_ctes("deep", "qt", "TF_IDF", DEPTH), O.qrels_cte(),
                                     "run AS (SELECT * FROM deep WHERE rank <= 2)", O.metrics_ctes("run", "qrels"))
       + " SELECT i.qid, round(coalesce(ap_sum, 0) / num_rel, 6) AS ap FROM m_i i LEFT JOIN m_a USING (qid)")
def ap_below_run_depth(spark, sf_dir):
    """Average precision cut at rank 2 of a run of depth 1,000."""
    run = rt.tf_idf(indexes.basic_index(spark, sf_dir), _qterms(spark, sf_dir), k=DEPTH)
    return ev.per_query(run, tables.qrels(spark, sf_dir), tables.topics(spark, sf_dir), ap_cut=2).select("qid", "ap")


@query("exp1_sample_10", _exp_sql([O.corpus_cte(), O.topics_cte(),
                                   _SAMPLE.replace(f"LIMIT {co.SAMPLE_SIZE}", "LIMIT 10"), O.index_ctes(),
                                   O.query_terms_cte("qt", "stopics")] + _four_sql("qt"),
                                  _four_runs("experiment1", lambda s: f"'{s}_sample_10_queries'"), topics="stopics"))
def exp1_sample_10(spark, sf_dir):
    """Experiment 1 on a seeded sample of 10 topics, fewer than there are."""
    return xp.experiment_1(indexes.basic_index(spark, sf_dir), tables.topics(spark, sf_dir),
                           tables.qrels(spark, sf_dir), sample=10)


@query("empty_ids_dropped", O.with_(O.splits_cte()) + """
 SELECT para_id, count(*) AS n FROM (SELECT CASE pos % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE para_id END AS para_id FROM splits)
 WHERE para_id IS NOT NULL AND para_id <> '' GROUP BY para_id""")
def empty_ids_dropped(spark, sf_dir):
    """Records without an id go; every seventh record here has an empty one, another seventh none."""
    rows = _union(spark, sf_dir).withColumn("para_id", F.when(F.col("pos") % 7 == 0, "").when(F.col("pos") % 7 == 1, None)
                                            .otherwise(F.col("para_id")))
    return co.non_empty_id(rows, "para_id").groupBy("para_id").agg(F.count(F.lit(1)).alias("n"))


@query("load_array_files", """
 SELECT CAST(row_number() OVER (PARTITION BY item_id % 2 ORDER BY item_id) - 1 AS INTEGER) AS pos,
        CAST(item_id AS VARCHAR) AS query_id, text AS question FROM benchmark""")
def load_array_files(spark, sf_dir):
    """A4, A5: passages written as two JSON arrays, beside a truncated one, an object and an empty file; read as one folder."""
    b = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question"))
    half = F.col("query_id").cast("long") % 2
    ordered = lambda d: d.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(          # noqa: E731
        F.col("query_id").cast("long").alias("at"), "query_id", "question"))),
        lambda r: F.struct(r["query_id"].alias("query_id"), r["question"].alias("question")))).alias("value"))
    path = temporary_path(spark, "arrays")
    whole = [ordered(b.filter(half == i)) for i in (0, 1)]
    broken = [whole[0].select(F.expr("substr(value, 1, length(value) - 3)").alias("value")),
              whole[1].select(F.concat(F.lit('{"items": '), "value", F.lit("}")).alias("value")),
              whole[0].select(F.lit("").alias("value"))]
    for i, d in enumerate([*whole, *broken]):
        d.coalesce(1).write.text(f"{path}/part{i}")
    json_io.check_paths(spark, path)
    return json_io.load_list_or_empty(spark, path).select("pos", "query_id", "question")


@query("custom_tokenizer", """
 SELECT doc_id AS docno, CAST(ceil(length(text) / CAST(3 AS DOUBLE)) AS BIGINT) AS n_tokens FROM documents""")
def custom_tokenizer(spark, sf_dir):
    """Lengths by a caller's tokenizer, here pieces of three characters."""
    from quarry.functions.text import count_tokens
    pieces = lambda s: [s[i:i + 3] for i in range(0, len(s), 3)]                                   # noqa: E731
    return tables.corpus(spark, sf_dir).select("docno", count_tokens("text", pieces).alias("n_tokens"))
