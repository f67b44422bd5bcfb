"""Effectiveness of ranked runs against relevance judgments.

Definitions (trec_eval conventions, Jarvelin & Kekalainen 2002 for nDCG):

* judged topics = topics with >= 1 relevant judgment, after restricting the
  judgments to the topics that were run (C4); means are over these, and a
  judged topic without results scores 0;
* ``P@k = |relevant in top k| / k`` (always divided by k);
* ``R@k = |relevant in top k| / |relevant|``;
* ``nDCG@k = sum_{rank<=k} rel / log2(rank + 1)`` divided by the same sum
  over the judgments sorted by relevance;
* ``AP = sum over relevant retrieved (hits so far / rank) / |relevant|``;
  ``AP@n`` only counts ranks <= n.  MAP is its mean.

A run is ``(qid, docno, rank)`` (plus an optional ``name``); judgments are
``(qid, docno, relevance)``; relevance > 0 is relevant and grades are gains.
Only run rows that hit a judgment are joined and aggregated, so the work
is proportional to the judgments, not to the run depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.util import SCORE_DECIMALS, broadcast_if_small

# The reference's metric list (P@1,5,10 R@5,10 nDCG@5,10 MAP) as columns.
METRICS = ("p_1", "p_5", "p_10", "r_5", "r_10", "ndcg_5", "ndcg_10", "map")


def clean_qrels(qrels: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Duplicate judgments collapse to their highest grade; C4 restricts
    them to ``topics`` when given."""
    q = qrels.groupBy("qid", "docno").agg(F.max("relevance").alias("relevance"))
    if topics is not None:
        q = q.join(topics.select("qid").distinct(), "qid", "left_semi")
    return q


def _ideal(qrels: DataFrame, cutoffs) -> DataFrame:
    """Per judged topic: number relevant and ideal DCG at each cutoff.

    The ideal ranking lists grades in descending order, so it is computed
    from counts per (topic, grade) - a partially aggregated group-by with a
    few rows per topic - instead of ranking every judgment of a topic in
    one window (a topic with a huge number of judgments stays cheap).
    Positions ``first .. last`` of a grade contribute
    ``grade * sum_{p} 1 / log2(p + 1)`` for ``p <= k``.
    """
    g = (qrels.filter(F.col("relevance") > 0)
         .groupBy("qid", "relevance").agg(F.count(F.lit(1)).alias("n")))
    by_grade = W.partitionBy("qid").orderBy(F.col("relevance").desc()) \
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    g = (g.withColumn("last", F.sum("n").over(by_grade))
          .withColumn("first", F.col("last") - F.col("n") + 1))
    aggs = [F.sum("n").alias("num_rel")]
    for k in cutoffs:
        pos = F.sequence(F.col("first"), F.least(F.col("last"), F.lit(k)))
        part = F.when(F.col("first") <= k, F.aggregate(
            pos, F.lit(0.0), lambda acc, p: acc + F.col("relevance") / F.log2(p + 1.0))).otherwise(0.0)
        aggs.append(F.sum(part).alias(f"idcg_{k}"))
    return g.groupBy("qid").agg(*aggs)


def _hit_aggs(p_cut, r_cut, ndcg_cut, ap_cut):
    aggs = [F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"hits_{k}")
            for k in sorted(set(p_cut) | set(r_cut))]
    aggs += [F.sum(F.when(F.col("rank") <= k, F.col("relevance") / F.log2(F.col("rank") + 1.0))
                   .otherwise(0.0)).alias(f"dcg_{k}") for k in ndcg_cut]
    rel_rank = F.col("rank") if ap_cut is None else F.when(F.col("rank") <= ap_cut, F.col("rank"))
    aggs.append(F.sum(F.col("hit_no") / rel_rank).alias("ap_sum"))
    return aggs


def per_query(run: DataFrame, qrels: DataFrame, topics: DataFrame | None = None,
              p_cut=(1, 5, 10), r_cut=(5, 10), ndcg_cut=(5, 10),
              ap_cut: int | None = None, group=()) -> DataFrame:
    """D11-D15 per judged topic (and per ``group`` columns, e.g. ``name``).

    Topics without results appear with zeros only when ``group`` is empty.
    """
    q = clean_qrels(qrels, topics)
    rel = q.filter(F.col("relevance") > 0)
    hits = run.select(*group, "qid", "docno", "rank").join(rel, ["qid", "docno"])
    return metrics_from_hits(hits, _ideal(q, ndcg_cut), p_cut, r_cut, ndcg_cut, ap_cut, group)


def label_hits(run: DataFrame, doc_labels: DataFrame, query_labels: DataFrame) -> DataFrame:
    """Run rows whose document has the query's label (relevance 1).

    ``doc_labels(docno, label)``, ``query_labels(qid, label)``.  The judgment
    pairs themselves (all pairs within a label) are never built.
    """
    ql = broadcast_if_small(query_labels.select("qid", F.col("label").alias("qlabel")))
    dl = broadcast_if_small(doc_labels.select("docno", "label"))
    return (run.join(ql, "qid").join(dl, "docno")
            .filter(F.col("label") == F.col("qlabel"))
            .select(*[c for c in run.columns if c not in ("score",)], F.lit(1).alias("relevance")))


def label_ideal(doc_labels: DataFrame, query_labels: DataFrame, cutoffs=(5, 10)) -> DataFrame:
    """Number relevant and ideal DCG per query when relevance = same label;
    the ideal ranking has ``min(k, num_rel)`` gains of 1."""
    counts = doc_labels.groupBy("label").agg(F.count(F.lit(1)).alias("num_rel"))
    out = query_labels.select("qid", "label").join(counts, "label").filter(F.col("num_rel") >= 1)
    for k in cutoffs:
        idx = F.sequence(F.lit(1), F.least(F.lit(k), F.col("num_rel")))
        out = out.withColumn(f"idcg_{k}", F.aggregate(
            idx, F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0)))
    return out.drop("label")


def metrics_from_hits(hits: DataFrame, ideal: DataFrame, p_cut=(1, 5, 10), r_cut=(5, 10),
                      ndcg_cut=(5, 10), ap_cut: int | None = None, group=()) -> DataFrame:
    """Metrics from relevant retrieved rows ``(<group>, qid, rank, relevance)``
    and per-topic ideals ``(qid, num_rel, idcg_k)``."""
    group = list(group)
    if ap_cut is not None:
        hits = hits.filter(F.col("rank") <= max([ap_cut, *p_cut, *r_cut, *ndcg_cut]))
    hits = hits.withColumn("hit_no", F.row_number().over(
        W.partitionBy(*group, "qid").orderBy("rank")))
    per = hits.groupBy(*group, "qid").agg(*_hit_aggs(p_cut, r_cut, ndcg_cut, ap_cut))
    if group:
        base = per.join(ideal, "qid")
    else:
        base = ideal.join(per, "qid", "left")
    cols = [*[F.col(g) for g in group], "qid"]
    for k in p_cut:
        cols.append((F.coalesce(F.col(f"hits_{k}"), F.lit(0)) / float(k)).alias(f"p_{k}"))
    for k in r_cut:
        cols.append((F.coalesce(F.col(f"hits_{k}"), F.lit(0)) / F.col("num_rel")).alias(f"r_{k}"))
    for k in ndcg_cut:
        cols.append((F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / F.col(f"idcg_{k}")).alias(f"ndcg_{k}"))
    cols.append((F.coalesce(F.col("ap_sum"), F.lit(0.0)) / F.col("num_rel")).alias("ap"))
    out = base.select(*cols)
    metric_cols = [c for c in out.columns if c not in (*group, "qid")]
    return out.select(*group, "qid", *[F.round(c, SCORE_DECIMALS).alias(c) for c in metric_cols])


def metrics_table(runs: DataFrame, qrels: DataFrame, topics: DataFrame | None = None,
                  p_cut=(1, 5, 10), r_cut=(5, 10), ndcg_cut=(5, 10),
                  ap_cut: int | None = None, map_name: str = "map",
                  names: list[str] | None = None) -> DataFrame:
    """One row per run ``name``, mean of each metric over judged topics.

    ``names`` lists the systems: one that found nothing gets a row of zeros, and
    the runs need not be read a second time for their names.

    ``runs`` is the union of named runs ``(name, qid, docno, rank)``.  Topics
    without results contribute 0, so each mean is a sum over topics with
    hits divided by the number of judged topics - no topic x system grid is
    materialised.
    """
    q = clean_qrels(qrels, topics)
    n_judged = q.filter(F.col("relevance") > 0).select("qid").distinct() \
        .agg(F.count(F.lit(1)).alias("n")).scalar()
    per = per_query(runs, q, None, p_cut, r_cut, ndcg_cut, ap_cut, group=["name"])
    metric_cols = [c for c in per.columns if c not in ("name", "qid")]
    sums = per.groupBy("name").agg(*[F.sum(c).alias(c) for c in metric_cols])
    if names is None:
        systems = runs.select("name").distinct()
    else:
        systems = runs.sparkSession.createDataFrame([(n,) for n in names], "name string")
    out = systems.join(sums, "name", "left").select(
        "name", *[F.round(F.try_divide(F.coalesce(F.col(c), F.lit(0.0)), n_judged),
                          SCORE_DECIMALS)
                  .alias(map_name if c == "ap" else c) for c in metric_cols])
    return out
