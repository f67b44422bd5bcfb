"""Sparse retrieval over an ``Index``.

The only query representation is a weighted term table
``query_terms(qid, term, weight double)`` (H5); plain queries weight each
term by its count in the query.  Retrieval is::

    query_terms (broadcast, size-checked) -> lexicon (idf, impacts)
        -> postings of the touched term buckets (streamed, pruned)
        -> sum per (qid, docno)   [bucket-local, docno-clustered scan]
        -> top-k per qid          [partial limit per bucket, then one shuffle]

Weighting models (Robertson & Zaragoza 2009), ``N`` documents, ``df`` term
document frequency, ``K = k1 * (1 - b + b * dl / avgdl)``:

* BM25:   ``w * log2((N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + K)``
  (negative for ``df > N/2``; not clamped)
* TF_IDF: ``w * log2(N / df + 1) * k1 * tf / (tf + K)``
* BM25F:  ``t = sum_f wf * tf_f / (1 - b + b * dl_f / avgdl_f)``,
  ``w * idf_bm25 * t / (k1 + t)``; rows with ``t = 0`` are dropped.

With ``ntf = tf / (1 - b + b * dl / avgdl)``, which the index stores, all three
are ``w * idf * a * ntf / (ntf + k1)`` and so increase with ``ntf``.

Pruning is exact.  A query's k-th score is at least the contribution of the
k-th best posting of any one of its terms, as far as the lexicon's ladder of
impacts tells it, less what terms of negative weight can take away.  A posting
so weak that its document stays below that even with every other term at its
largest impact is left out: its document cannot be among the best k, and no
other document's score changes.  For a handful of terms these least impacts go
to the scan as literals, where Parquet's statistics skip whole blocks of a
term's postings (files are sorted by term and impact).  Larger query tables with
a depth ``k`` are answered by blocks (``_by_blocks``): all their postings are
read, but pairs of a query and a matching document are added up in arrays, and
of a block only the share of the best ``k`` that falls to it is returned.

Scores are rounded to 6 decimals before ranking; ties go to the smaller
``docno``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.index import B_LENGTH, LADDER, PUSHED_DOCS, Index, length_normalised, term_bucket
from quarry.operators.util import (BROADCAST_MAX_BYTES, SCORE_DECIMALS, broadcast_if_small, known_size,
                                   known_values, one_array, read_back, round_score, round_scores, stored, top_k)

K1, B = 1.2, 0.75
DEFAULT_DEPTH = 1000
MODELS = ("BM25", "TF_IDF")
PUSHED_TERMS = 64       # up to so many query terms reach the scan as literals
BLOCK_DOCS, BLOCK_TERMS = 32_768, 4_000_000     # documents, query terms of a block, on average
FEW_ROWS = 2_000_000    # up to so many rows of partial results more, blocks return their whole best k
SLACK = 1e-5            # scores are rounded, so bounds give way by more than that


def query_terms(topics: DataFrame, index: Index, qid: str = "qid", query: str = "query") -> DataFrame:
    """Plain query -> ``(qid, term, weight)`` with weight = term count, by the
    term rule of the index that is to answer (its stop list and stemming)."""
    return (topics.select(F.col(qid).alias("qid"), F.explode(index.terms(F.col(query))).alias("term"))
            .groupBy("qid", "term").agg(F.count(F.lit(1)).cast("double").alias("weight")))


def _idf(model: str, n_docs: int):
    df = F.col("df").cast("double")
    if model in ("BM25", "BM25F"):
        return F.log2((F.lit(float(n_docs)) - df + 0.5) / (df + 0.5))
    if model == "TF_IDF":
        return F.log2(F.lit(float(n_docs)) / df + 1.0)
    raise ValueError(f"unknown weighting model {model!r}; use one of {MODELS + ('BM25F',)}")


def _touched(index: Index, qterms: DataFrame) -> list[int] | None:
    """Term buckets that a query table of bounded size touches."""
    if known_size(qterms)[1] > BROADCAST_MAX_BYTES:
        return None
    return known_values(qterms, f"buckets{index.term_buckets}", term_bucket("term", index.term_buckets))


def _in_buckets(df: DataFrame, buckets: list[int] | None) -> DataFrame:
    """Partitions that the query touches; the literals prune at planning."""
    return df if buckets is None else df.filter(F.col("term_bucket").isin(buckets))


def _weighted_terms(index: Index, qterms: DataFrame, model: str, buckets: list[int] | None):
    """Query terms joined to the lexicon: ``(qid, term_bucket, term, w,
    impacts)``.  The lexicon has one row per term, so the join cannot grow the
    query-term table."""
    qt = qterms.select("qid", "term", F.col("weight").cast("double").alias("weight")) \
        .withColumn("term_bucket", term_bucket("term", index.term_buckets))
    rows, size = known_size(qterms)
    lex = _in_buckets(index.lexicon, buckets).select("term_bucket", "term", "df", "impacts")
    return (broadcast_if_small(qt, size=size + 8 * rows).join(lex, ["term_bucket", "term"])
            .select("qid", "term_bucket", "term", (F.col("weight") * _idf(model, index.n_docs)).alias("w"), "impacts"))


def _floored(weighted: DataFrame, k: int | None, top: float, k1: float, field_weights: dict[int, float]) -> DataFrame:
    """``(qid, term_bucket, term, w, least)``: below ``least`` (of the weighted
    sum of impacts over fields) a posting's document is not among the best
    ``k``.  A term contributes ``w * top * x / (x + k1)`` at impact ``x``."""
    if k is None or min(field_weights.values()) < 0:
        return weighted.select("qid", "term_bucket", "term", "w", F.lit(0.0).alias("least"))
    w = F.col("w")
    impact = lambda i: F.get(F.col("impacts"), F.lit(i))                                  # noqa: E731
    score = lambda x: w * top * x / (x + k1)                                              # noqa: E731
    largest = sum((F.coalesce(impact(i)["max"], F.lit(0.0)) * x for i, x in field_weights.items()), F.lit(0.0))
    reached = [F.coalesce(*[F.when(F.get(impact(i)["reach"], F.lit(j)) >= k, F.lit(LADDER[j] * x))
                            for j in reversed(range(len(LADDER)))], F.lit(0.0)) for i, x in field_weights.items()]
    sure = reached[0] if len(reached) == 1 else F.greatest(*reached)
    of_query = W.partitionBy("qid")
    t = (weighted.withColumn("most", F.when(w > 0, score(largest)).otherwise(0.0))
         .withColumn("loss", F.when(w < 0, score(largest)).otherwise(0.0))
         .withColumn("sure", F.when(w > 0, score(sure)).otherwise(0.0))
         .withColumn("floor", F.max("sure").over(of_query) + F.sum("loss").over(of_query))
         .withColumn("others", F.sum("most").over(of_query) - F.col("most")))
    # the share of this term's ceiling that a document needs of it
    share = (F.col("floor") - F.col("others") - SLACK - 1e-9 * (F.col("others") + F.col("most"))) / (w * top)
    least = F.when((w > 0) & (F.col("floor") > 0) & (share > 0),
                   F.when(share < 1, k1 * share / (1 - share)).otherwise(F.lit(float("inf")))).otherwise(0.0)
    return t.select("qid", "term_bucket", "term", "w", least.alias("least"))


def _broadcast_terms(floored: DataFrame, qterms: DataFrame) -> DataFrame:
    rows, size = known_size(qterms)
    return broadcast_if_small(floored, size=size + 16 * rows)


def _matched(index: Index, floored: DataFrame, qterms: DataFrame, buckets: list[int] | None, field: int):
    """Postings of one field that meet a query term: those of the touched
    buckets, for a few terms only their blocks of sufficient impact."""
    post = _in_buckets(index.postings, buckets).filter(F.col("field") == field)
    if known_size(qterms)[0] <= PUSHED_TERMS:
        rows = floored.collect()                 # at most PUSHED_TERMS, here and in the literals
        least: dict[str, float] = {}
        for r in rows:
            least[r.term] = min(r.least, least.get(r.term, r.least))
        wanted = [(F.col("term") == t) & (F.col("ntf") >= x) if x > 0 else F.col("term") == t
                  for t, x in sorted(least.items())]
        post = post.filter(reduce(lambda a, b: a | b, wanted, F.lit(False)))
        floored = floored.sparkSession.createDataFrame(rows, floored.schema)
    return post.join(_broadcast_terms(floored, qterms), ["term_bucket", "term"])


def _best_of_block(k: int, top: float, k1: float, whole_terms: bool):
    """Function of one block's postings ``(docno, terms, ts)`` and queries ``(qid,
    terms, ws)``: its best ``k`` documents a query; ``cut`` marks the last of them
    where there were more.  Terms are joined by spaces."""
    def runs(codes, n):
        """Order that sorts codes, and where each code's run begins and ends."""
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=n))
        return order, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends

    def coded(column):
        c = one_array(one_array(column).dictionary_encode(null_encoding="encode"))
        return c.dictionary, c.indices.to_numpy(zero_copy_only=False)

    def split(table, values):
        """A column of joined terms: one array, the values to them, and how many each row has."""
        lists = one_array(table[values])
        return (pc.split_pattern(one_array(table["terms"]), " ").flatten(), lists.flatten().to_numpy(zero_copy_only=False),
                pc.list_value_length(lists).to_numpy(zero_copy_only=False))

    def best(post, asked):
        qid_type, docno_type = asked.schema.field("qid").type, post.schema.field("docno").type
        schema = pa.schema([("qid", qid_type), ("docno", docno_type), ("score", pa.float64()), ("cut", pa.bool_())])
        if not post.num_rows or not asked.num_rows:
            return schema.empty_table()
        ids, doc = coded(post["docno"])
        order = pc.array_sort_indices(ids, null_placement="at_start")      # documents by id, so ties go to the smaller
        place = np.empty(len(ids), np.int32)
        place[order.to_numpy()] = np.arange(len(ids))
        ids, doc = ids.take(order), place[doc]
        words, t, many = split(post, "ts")
        words, term = coded(words)
        doc, some = np.repeat(doc, many), t > 0
        if not some.all():
            doc, term, t = doc[some], term[some], t[some]
        if whole_terms:                     # a term's fields count as one
            key, inverse = np.unique(term.astype(np.int64) * len(ids) + doc, return_inverse=True)
            t, term, doc = np.bincount(inverse, weights=t), key // len(ids), key % len(ids)
        by_term, begin, end = runs(term, len(words))
        doc, x = doc[by_term], t[by_term]
        x = top * x / (x + k1)
        at, w, many = split(asked, "ws")
        last = np.cumsum(many, dtype=np.int64)
        at = pc.index_in(at, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(at >= 0)
        at, w, last = at[known], w[known], np.searchsorted(known, last)
        first = np.concatenate([[0], last[:-1]])
        out_q, out_d, out_s, out_c = [], [], [], []
        for n in np.flatnonzero(last > first):
            mine = range(first[n], last[n])
            hit = np.concatenate([doc[begin[at[i]]:end[at[i]]] for i in mine])
            part = np.concatenate([w[i] * x[begin[at[i]]:end[at[i]]] for i in mine])
            total = np.bincount(hit, weights=part, minlength=len(ids))
            seen = np.zeros(len(ids), bool)
            seen[hit] = True
            found = np.flatnonzero(seen)
            s = total[found]
            more = len(s) > k
            if more:                        # (rounding keeps the order, so it can wait for those near the k-th)
                keep = s >= np.partition(s, len(s) - k)[len(s) - k] - SLACK
                found, s = found[keep], s[keep]
            s = round_scores(s)
            if more:
                keep = np.argsort(-s, kind="stable")[:k]
                found, s = found[keep], s[keep]
            out_q.append(np.full(len(s), n))
            out_d.append(found)
            out_s.append(s)
            out_c.append(np.arange(len(s)) == (k - 1 if more else -1))
        if not out_q:
            return schema.empty_table()
        return pa.table([one_array(asked["qid"]).take(pa.array(np.concatenate(out_q))),
                         ids.take(pa.array(np.concatenate(out_d))), pa.array(np.concatenate(out_s)),
                         pa.array(np.concatenate(out_c))], schema=schema)
    return best


def block_share(k: int, blocks: int) -> int:
    """Rows of a query's best ``k`` that each of ``blocks`` returns at first: its
    even share and six standard deviations."""
    even = k / blocks
    return min(k, math.ceil(even + 6 * math.sqrt(even) + 3))


def _by_blocks(index: Index, weighted: DataFrame, buckets: list[int] | None, weights: dict[int, float], b: float,
               k: int, top: float, k1: float) -> DataFrame:
    """Retrieval over fields of these ``weights`` for many query terms: documents
    and queries are dealt into blocks of bounded size, and each pair of blocks is
    one group that adds up its scores in arrays and keeps its best a query.
    A posting crosses the network once for each block of queries, and pairs of a
    query and a matching document never become rows.

    Documents are dealt by hash, so of a query's best ``k`` a block holds about
    its even share.  Where whole lists of ``k`` would be many rows, a block returns
    ``block_share`` rows a query only.  Where the last of these is itself among the
    best and the block had more, the query is asked again for all ``k`` of each
    block: nothing is lost however the documents fell.  So many queries ask for
    most terms, and the forward table's documents travel instead of postings: a
    document's id once, its terms in one string."""
    asked = stored(weighted.groupBy("qid").agg(F.collect_list(F.struct("term", "w")).alias("t"))
                   .select("qid", F.array_join("t.term", " ").alias("terms"), F.col("t.w").alias("ws")), "weighted")
    queries, rows = (int(x or 0) for x in asked.agg(F.count(F.lit(1)), F.sum(F.size("ws"))).first())
    cores = int(asked.sparkSession.sparkContext.defaultParallelism)
    q_blocks = max(1, -(-rows // BLOCK_TERMS))
    d_blocks = max(1, -(-index.n_docs // BLOCK_DOCS), -(-cores // q_blocks))
    share = block_share(k, d_blocks)
    whole = queries * d_blocks * (k - share) <= FEW_ROWS
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")                     # noqa: E731
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))                       # noqa: E731
    per_field = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("field") + 1)      # noqa: E731
    fields = range(len(index.fields))
    weight, avgdl = per_field([weights.get(i, 0.0) for i in fields]), per_field([index.avgdl(i) for i in fields])
    types = [f"{c} {f.schema[c].dataType.simpleString()}" for c, f in (("qid", asked), ("docno", index.postings))]

    def postings(asked: DataFrame) -> DataFrame:
        words = (asked.select(F.explode(F.split("terms", " ")).alias("term")).distinct()
                 .select(term_bucket("term", index.term_buckets).alias("term_bucket"), "term"))
        ntf = F.col("ntf") if b == B_LENGTH else length_normalised("tf", "dl", avgdl, b)
        return (_in_buckets(index.postings, buckets).filter(F.col("field").isin(sorted(weights)))
                .join(broadcast_if_small(words), ["term_bucket", "term"], "left_semi")
                .select("docno", F.col("term").alias("terms"), F.array(weight * ntf).alias("ts")))

    def documents() -> DataFrame:
        t = lambda x: weight * length_normalised(x["tf"], "dl", avgdl, b)                # noqa: E731
        return (index.forward.filter(F.col("field").isin(sorted(weights)) & (F.size("terms") > 0))
                .select("docno", F.array_join("terms.term", " ").alias("terms"), F.transform("terms", t).alias("ts")))

    def ranked(asked: DataFrame, n: int) -> DataFrame:
        """The best ``k`` of the best ``n`` of each block."""
        post = (postings(asked) if whole or n == k else documents()) \
            .select("docno", "terms", "ts", block("docno", d_blocks).alias("db"), each(q_blocks).alias("qb"))
        queries = asked.select("qid", "terms", "ws", block("qid", q_blocks).alias("qb"), each(d_blocks).alias("db"))
        best = _best_of_block(n, top, k1, whole_terms=len(weights) > 1)

        def score(post_, queries_):
            return best(post_.select(["docno", "terms", "ts"]), queries_.select(["qid", "terms", "ws"]))

        partial = (post.groupBy("db", "qb").cogroup(queries.groupBy("db", "qb"))
                   .applyInArrow(score, f"{', '.join(types)}, score double, cut boolean"))
        return top_k(partial, k, parts=d_blocks).select("qid", "docno", "score", "rank", "cut")

    if whole:
        return ranked(asked, k).drop("cut")
    found = stored(ranked(asked, share), "ranked")
    again = stored(found.filter(F.col("cut") & (F.col("rank") < k)).select(F.col("qid").alias("again")).distinct(), "again")
    if not known_size(again)[0]:
        return read_back(found.drop("cut"))
    once_more = F.col("qid").eqNullSafe(F.col("again"))
    again = broadcast_if_small(again)
    return (found.join(again, once_more, "left_anti")
            .unionByName(ranked(asked.join(again, once_more, "left_semi"), k)).drop("cut"))


def retrieve(index: Index, qterms: DataFrame, model: str = "BM25",
             k: int | None = DEFAULT_DEPTH, k1: float = K1, b: float = B,
             field: int = 0) -> DataFrame:
    """H1/H2/H5: ranked run ``(qid, docno, score, rank)``, at most ``k`` per qid.

    With another ``b`` than that of the stored impacts nothing is pruned and
    the lengths are normalised anew."""
    if model not in MODELS:
        raise ValueError(f"unknown weighting model {model!r}; use one of {MODELS}")
    buckets = _touched(index, qterms)
    top = k1 + 1.0 if model == "BM25" else k1
    stored = b == B_LENGTH
    if k is not None and known_size(qterms)[0] > PUSHED_TERMS:
        return _by_blocks(index, _weighted_terms(index, qterms, model, buckets), buckets, {field: 1.0}, b, k, top, k1)
    floored = _floored(_weighted_terms(index, qterms, model, buckets), k if stored else None, top, k1, {field: 1.0})
    ntf = F.col("ntf") if stored else length_normalised("tf", "dl", F.lit(index.avgdl(field)), b)
    scores = (_matched(index, floored, qterms, buckets, field).filter(F.col("ntf") >= F.col("least"))
              .groupBy("qid", "docno").agg(F.sum(F.col("w") * (top * ntf / (ntf + k1))).alias("score"))
              .withColumn("score", round_score("score")))
    return top_k(scores, k, parts=index.doc_buckets).select("qid", "docno", "score", "rank")


def bm25(index: Index, qterms: DataFrame, k: int | None = DEFAULT_DEPTH, **kw) -> DataFrame:
    return retrieve(index, qterms, "BM25", k, **kw)


def tf_idf(index: Index, qterms: DataFrame, k: int | None = DEFAULT_DEPTH, **kw) -> DataFrame:
    return retrieve(index, qterms, "TF_IDF", k, **kw)


def bm25f(index: Index, qterms: DataFrame, weights, k: int | None = DEFAULT_DEPTH,
          k1: float = K1, b: float = B) -> DataFrame:
    """H3: BM25F over a fielded index; ``weights[i]`` is the weight of field i
    (the reference's controls ``w.0``, ``w.1``)."""
    weights = [float(x) for x in weights]
    if len(weights) != len(index.fields):
        raise ValueError(f"need {len(index.fields)} field weights, got {len(weights)}")
    buckets = _touched(index, qterms)
    used = {i: x for i, x in enumerate(weights) if x != 0} or {0: 0.0}
    stored = b == B_LENGTH
    at = F.col("field") + 1
    wf = F.element_at(F.array(*[F.lit(x) for x in weights]), at)
    avg = F.element_at(F.array(*[F.lit(index.avgdl(i)) for i in range(len(weights))]), at)
    ntf = F.col("ntf") if stored else length_normalised("tf", "dl", avg, b)
    if k is not None and known_size(qterms)[0] > PUSHED_TERMS:
        return _by_blocks(index, _weighted_terms(index, qterms, "BM25F", buckets), buckets, used, b, k, 1.0, k1)
    floored = _floored(_weighted_terms(index, qterms, "BM25F", buckets), k if stored else None, 1.0, k1, used)
    post = _in_buckets(index.postings, buckets).filter(F.col("field").isin(sorted(used)))
    matched = post.join(_broadcast_terms(floored, qterms), ["term_bucket", "term"])
    if len(used) == 1:          # a term has one posting a document
        per_term = matched.select("qid", "docno", "w", "least", (wf * ntf).alias("t"))
    else:
        per_term = matched.groupBy("qid", "docno", "term").agg(
            F.sum(wf * ntf).alias("t"), F.first("w").alias("w"), F.first("least").alias("least"))
    scores = (per_term.filter((F.col("t") > 0) & (F.col("t") >= F.col("least")))
              .groupBy("qid", "docno")
              .agg(F.sum(F.col("w") * F.col("t") / (k1 + F.col("t"))).alias("score"))
              .withColumn("score", round_score("score")))
    return top_k(scores, k, parts=index.doc_buckets).select("qid", "docno", "score", "rank")


def rm3_terms(index: Index, run: DataFrame, qterms: DataFrame, fb_docs: int = 3,
              fb_terms: int = 10, fb_lambda: float = 0.6, field: int = 0) -> DataFrame:
    """H4 (first half): RM3 query model from the top ``fb_docs`` documents.

    ``P(t) ~ sum_d tf(t,d)/dl(d) * s_d / sum s`` over the feedback documents
    (equal document weights when ``sum s <= 0``); keep the top ``fb_terms``
    (ties by term), normalise to 1, and mix
    ``lambda * q / sum q + (1 - lambda) * P``.  Returns ``(qid, term, weight)``;
    terms whose weight is 0 are dropped (they would match without scoring).

    The feedback documents (at most ``fb_docs`` a query) are written once and
    their terms come from the index's forward table; no posting is read.
    """
    per_q = W.partitionBy("qid")
    fb = (run.filter(F.col("rank") <= fb_docs).select("qid", "docno", "score")
          .withColumn("tot", F.sum("score").over(per_q))
          .withColumn("cnt", F.count(F.lit(1)).over(per_q))
          .select("qid", "docno",
                  F.when(F.col("tot") > 0, F.col("score") / F.col("tot"))
                   .otherwise(1.0 / F.col("cnt")).alias("dw")))
    fb = stored(fb, "feedback")
    forward = index.forward.filter(F.col("field") == field)
    if known_size(fb)[0] <= PUSHED_DOCS:      # the literals prune buckets
        forward = forward.filter(F.col("docno").isin(known_values(fb, "docnos", F.col("docno"))))
    post = (forward.join(broadcast_if_small(fb), "docno")
            .select("qid", "dl", "dw", F.explode("terms").alias("t"))
            .select("qid", "dl", "dw", F.col("t.term").alias("term"), F.col("t.tf").alias("tf")))
    p = (post.groupBy("qid", "term")
         .agg(F.sum(F.col("tf").cast("double") / F.col("dl") * F.col("dw")).alias("p"))
         .withColumn("p", F.round("p", SCORE_DECIMALS)))
    p = (p.withColumn("r", F.row_number().over(
            W.partitionBy("qid").orderBy(F.col("p").desc(), F.col("term"))))
          .filter(F.col("r") <= fb_terms)
          .withColumn("p", F.try_divide(F.col("p"), F.sum("p").over(per_q)))
          .select("qid", "term", "p"))
    q = qterms.select("qid", "term", (F.col("weight") / F.sum("weight").over(per_q)).alias("q"))
    return (q.join(p, ["qid", "term"], "full_outer")
            .select("qid", "term",
                    F.round(fb_lambda * F.coalesce("q", F.lit(0.0))
                            + (1.0 - fb_lambda) * F.coalesce("p", F.lit(0.0)),
                            SCORE_DECIMALS + 3).alias("weight"))
            .filter(F.col("weight") != 0))


def rm3(index: Index, qterms: DataFrame, model: str = "BM25", k: int | None = DEFAULT_DEPTH,
        first_run: DataFrame | None = None, fb_docs: int = 3, fb_terms: int = 10,
        fb_lambda: float = 0.6) -> DataFrame:
    """H4: ``model >> RM3 >> model`` (the first run may be passed in; of it
    only the feedback documents are needed, so only those are retrieved).

    The expanded query (at most original terms + queries x ``fb_terms`` rows)
    is written once: its size is then known, and the second pass reads the
    postings of its terms only."""
    run1 = first_run if first_run is not None else retrieve(index, qterms, model, fb_docs)
    expanded = stored(rm3_terms(index, run1, qterms, fb_docs, fb_terms, fb_lambda), "expanded")
    return retrieve(index, expanded, model, k)


def cutoff(run: DataFrame, k: int) -> DataFrame:
    """Rank cutoff ``run % k`` (idempotent)."""
    return run.filter(F.col("rank") <= k)
