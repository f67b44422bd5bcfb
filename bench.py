"""Benchmark: headline operators on the driver's tables.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line.  Every timed step forces
full evaluation with a ``noop`` write (all columns computed, nothing
collected to the driver).  Indexes are built fresh into the shared folder
and the build time is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quarry.operators import answer as an  # noqa: E402
from quarry.operators import dense as de  # noqa: E402
from quarry.operators import index as ix  # noqa: E402
from quarry.operators import keywords as kw  # noqa: E402
from quarry.operators import rerank as rr  # noqa: E402
from quarry.operators import retrieve as rt  # noqa: E402
from quarry.plans import experiments as xp  # noqa: E402
from quarry.session import local_session, scratch_path  # noqa: E402
from quarry.sources import tables, thesaurus  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=2 * cpus, app="quarry-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, make):
        t0 = time.time()
        out = make()
        if out is not None and hasattr(out, "write"):
            out.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        return out

    docs = tables.corpus(spark, sf_dir)
    topics = tables.topics(spark, sf_dir)
    th = thesaurus.fixture(spark)

    idx = timed("index_build", lambda: ix.build_index(docs, scratch_path(spark, "bench-basic")))
    qt = rt.query_terms(topics, idx)
    timed("bm25", lambda: rt.bm25(idx, qt, 1000))
    timed("tfidf", lambda: rt.tf_idf(idx, qt, 1000))
    timed("rm3_bm25", lambda: rt.rm3(idx, qt, "BM25", 1000))
    qrels = timed("qrels_containment", lambda: tables.qrels(spark, sf_dir))

    timed("experiment1_table", lambda: xp.experiment_1(idx, topics, qrels))
    timed("rake_keywords", lambda: kw.rake_keywords(docs))
    idx2 = timed("two_field_index_build", lambda: ix.build_index(
        kw.expand_documents(docs, th, replace=False), scratch_path(spark, "bench-two"),
        fields=("text", "keywords"), store=False))
    timed("bm25f_mixed", lambda: rt.bm25f(idx2, qt, (0.7, 0.3), 1000))
    timed("query_expand_bm25", lambda: rt.bm25(idx, rt.query_terms(kw.expand_queries(topics, th), idx), 1000))

    vec = tables.vectors(spark, sf_dir).select(F.col("vec_id").alias("docno"), F.col("embedding").alias("vec"))
    qv = vec.filter("docno % 20 = 0").withColumnRenamed("docno", "qid")
    timed("dense_topk", lambda: de.exhaustive_topk(vec, qv, 1000))
    dv = timed("dense_index_build", lambda: de.store_vectors(
        de.document_vectors(idx), scratch_path(spark, "bench-dense"), source=docs))
    timed("dense_rerank", lambda: de.rerank(rt.bm25(idx, qt, 1000), dv, de.query_vectors(topics, idx)))

    def maxp():
        run = rt.bm25(idx, qt, 100)
        return rr.max_passage(rr.coverage_scores(rr.run_passages(run, idx), topics, idx))
    timed("max_passage", maxp)

    def qa():
        q = tables.questions(spark, sf_dir)
        run = rt.bm25(idx, rt.query_terms(q, idx), 100)
        ctx = an.context(rr.max_passage(rr.coverage_scores(rr.run_passages(run, idx), q, idx)))
        return an.final_answers(an.generate(an.prompts_tool(q, ctx)))
    timed("qa_answers", qa)

    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
