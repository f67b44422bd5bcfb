"""The reference's experiments as named runs plus one metric table.

Each ``experiment_N`` builds its systems as DataFrame functions (H10:
``a >> b`` is function composition, ``a % k`` is ``cutoff``), tags every run
with the reference's system name, unions them and computes the mean
metric table (D16).  Judgments are restricted to the topics run (C4).
With ``sample`` the topics are a seeded sample and the names carry its
size (J7).  With ``save_dir`` each run is written in TREC format and
re-used on the next call (A8, A9) that has the same topics, index build and
other inputs: their contents are part of the folder's name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import collection as co
from quarry.operators import dense as de
from quarry.operators import evaluate as ev
from quarry.operators import index as ix
from quarry.operators import keywords as kw
from quarry.operators import rerank as rr
from quarry.operators import retrieve as rt
from quarry.operators.util import content_key, stored, top_k
from quarry.sources import runs as runs_io

DEPTH = 1000


def _names(prefix: str, systems: list[str], sample_size: int | None) -> list[str]:
    if sample_size is None:
        return [f"{prefix}_{s}" for s in systems]
    return [f"{prefix}_{s}_sample_{sample_size}_queries" for s in systems]


def lazily(make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """``make``'s run, made and written at the first call."""
    made = []

    def run():
        if not made:
            made.append(stored(make(), "run"))
        return made[0]
    return run


def evaluate_systems(systems: list[tuple[str, Callable[[], DataFrame]]], qrels: DataFrame,
                     topics: DataFrame, save_dir: str | None = None, params: str = "",
                     ap_cut: int | None = None, map_name: str = "map") -> DataFrame:
    """D16 over named systems; each system is a zero-argument function
    returning a run ``(qid, docno, score, rank)``."""
    spark = topics.sparkSession
    qid_t = topics.schema["qid"].dataType.simpleString()
    parts = []
    for name, make in systems:
        if save_dir:
            path = runs_io.run_path(save_dir, name, params)
            run = runs_io.reuse(spark, path, make, name, qid_type=qid_t,
                                docno_type=qrels.schema["docno"].dataType.simpleString())
            run = run.drop("name")
        else:
            run = stored(make(), "run")      # metrics, feedback and re-ranking read it from there
        parts.append(run.select("qid", "docno", "rank").withColumn("name", F.lit(name)))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return ev.metrics_table(union, qrels, topics, ap_cut=ap_cut, map_name=map_name,
                            names=[name for name, _ in systems])


def _params(save_dir: str | None, index: ix.Index, topics: DataFrame, *others) -> str:
    """Key of what a saved run depends on (empty where none is saved): the index
    build, the rows of ``topics(qid, query)`` and of other inputs."""
    if not save_dir:
        return ""
    keys = [content_key(x) if isinstance(x, DataFrame) else str(x) for x in others]
    return "|".join([index.build_id, content_key(topics.select("qid", "query")), str(DEPTH), *keys])


def _topics_and_size(topics: DataFrame, sample: int | None):
    if sample is None:
        return topics, None
    t = co.sample_topics(topics, sample)
    return t, t.count()


def experiment_0(index: ix.Index, topics: DataFrame, qrels: DataFrame) -> DataFrame:
    """J0 (notebook): TF_IDF, BM25 and BM25+RM3 with AP@1000, P@5, P@10."""
    qt = rt.query_terms(topics, index)
    bm25 = lazily(lambda: rt.bm25(index, qt, DEPTH))
    systems = [("TF_IDF", lambda: rt.tf_idf(index, qt, DEPTH)),
               ("BM25", bm25),
               ("BM25_RM3", lambda: rt.rm3(index, qt, "BM25", DEPTH, first_run=bm25()))]
    t = evaluate_systems(systems, qrels, topics, ap_cut=1000, map_name="ap_1000")
    return t.select("name", "ap_1000", "p_5", "p_10")


def _four(index, topics, prefix, sample_size):
    qt = rt.query_terms(topics, index)
    names = _names(prefix, ["bm25", "bm25_rm3", "tfidf", "tfidf_rm3"], sample_size)
    # the RM3 pipelines reuse the plain runs as their first stage
    bm25, tfidf = lazily(lambda: rt.bm25(index, qt, DEPTH)), lazily(lambda: rt.tf_idf(index, qt, DEPTH))
    makers = [bm25, lambda: rt.rm3(index, qt, "BM25", DEPTH, first_run=bm25()),
              tfidf, lambda: rt.rm3(index, qt, "TF_IDF", DEPTH, first_run=tfidf())]
    return list(zip(names, makers))


def experiment_1(index: ix.Index, topics: DataFrame, qrels: DataFrame, sample: int | None = None,
                 save_dir: str | None = None) -> DataFrame:
    """BM25, BM25+RM3, TF_IDF, TF_IDF+RM3 on the full-text index."""
    t, n = _topics_and_size(topics, sample)
    return evaluate_systems(_four(index, t, "experiment1", n), qrels, t, save_dir,
                            _params(save_dir, index, t))


def experiment_2(index: ix.Index, topics: DataFrame, qrels: DataFrame, thesaurus: DataFrame,
                 sample: int | None = None, save_dir: str | None = None) -> DataFrame:
    """The four systems on thesaurus-expanded queries."""
    t, n = _topics_and_size(topics, sample)
    x = kw.expand_queries(t, thesaurus)
    return evaluate_systems(_four(index, x, "experiment2", n), qrels, t, save_dir,
                            _params(save_dir, index, x))


def experiment_3(kw_index: ix.Index, topics: DataFrame, qrels: DataFrame, thesaurus: DataFrame,
                 sample: int | None = None, save_dir: str | None = None) -> DataFrame:
    """Keyword-only index, BM25 and BM25+RM3, original (A) and
    expanded (B) queries."""
    t, n = _topics_and_size(topics, sample)
    x = kw.expand_queries(t, thesaurus)
    qa, qb = rt.query_terms(t, kw_index), rt.query_terms(x, kw_index)
    names = _names("experiment3A", ["bm25", "bm25_rm3"], n) + _names("experiment3B", ["bm25", "bm25_rm3"], n)
    ra, rb = lazily(lambda: rt.bm25(kw_index, qa, DEPTH)), lazily(lambda: rt.bm25(kw_index, qb, DEPTH))
    makers = [ra, lambda: rt.rm3(kw_index, qa, "BM25", DEPTH, first_run=ra()),
              rb, lambda: rt.rm3(kw_index, qb, "BM25", DEPTH, first_run=rb())]
    return evaluate_systems(list(zip(names, makers)), qrels, t, save_dir,
                            _params(save_dir, kw_index, t, x.select("qid", "query")))


BM25F_SETTINGS = (("bm25f_keywords", (0.0, 1.0)), ("bm25f_text", (1.0, 0.0)),
                  ("bm25f_combination", (0.7, 0.3)))


def experiment_4(two_field_index: ix.Index, topics: DataFrame, qrels: DataFrame,
                 sample: int | None = None, save_dir: str | None = None) -> DataFrame:
    """BM25F weighting keywords only, text only, and 0.7 / 0.3."""
    t, n = _topics_and_size(topics, sample)
    qt = rt.query_terms(t, two_field_index)
    names = _names("experiment4", [s for s, _ in BM25F_SETTINGS], n)
    makers = [(lambda w=w: rt.bm25f(two_field_index, qt, w, DEPTH)) for _, w in BM25F_SETTINGS]
    return evaluate_systems(list(zip(names, makers)), qrels, t, save_dir,
                            _params(save_dir, two_field_index, t))


def experiment_5(index: ix.Index, doc_vectors: DataFrame, query_vectors: DataFrame, topics: DataFrame,
                 qrels: DataFrame, sample: int | None = None, save_dir: str | None = None) -> DataFrame:
    """Exhaustive dense retrieval, and BM25 top 1000 re-ranked densely.
    ``doc_vectors(docno, vec)``, ``query_vectors(qid, vec)``."""
    t, n = _topics_and_size(topics, sample)
    qv = stored(query_vectors.join(t.select("qid"), "qid", "left_semi"), "query-vectors")
    qt = rt.query_terms(t, index)
    names = _names("experiment5", ["biencoder", "bm25_biencoder"], n)
    makers = [lambda: de.exhaustive_topk(doc_vectors, qv, DEPTH),
              lambda: de.rerank(rt.cutoff(rt.bm25(index, qt, DEPTH), 1000), doc_vectors, qv)]
    return evaluate_systems(list(zip(names, makers)), qrels, t, save_dir,
                            _params(save_dir, index, t, doc_vectors, qv))


def experiment_6(index: ix.Index, topics: DataFrame, qrels: DataFrame, sample: int | None = None,
                 save_dir: str | None = None, score_fn=None, batch_size: int = rr.BATCH_SIZE,
                 scorer_id: str | None = None) -> DataFrame:
    """BM25 top 100 re-ranked by a pair scorer over the document text
    (``score_fn`` = a cross-encoder; default: the coverage stand-in).  Saved
    runs of a ``score_fn`` need a ``scorer_id`` that names its model."""
    if save_dir and score_fn is not None and not scorer_id:
        raise ValueError("a saved run needs scorer_id, as a function does not tell which model it holds")
    t, n = _topics_and_size(topics, sample)
    qt = rt.query_terms(t, index)

    def make():
        first = ix.get_text(rt.bm25(index, qt, 100), index).drop("rank", "score")
        if score_fn is None:
            scored = rr.coverage_scores(first, t, index)
        else:
            scored = rr.model_scores(first.join(t.select("qid", "query"), "qid"), score_fn, batch_size)
        return top_k(scored.select("qid", "docno", "score"), None)

    return evaluate_systems([(_names("experiment6", ["bm25_monoT5"], n)[0], make)],
                            qrels, t, save_dir,
                            _params(save_dir, index, t, scorer_id or "coverage"))
