"""Passages and second-stage re-ranking.

Passages (G11) are token windows of ``length`` with ``stride``: starts
0, stride, 2*stride, ... while ``start = 0 or start < n - (length - stride)``,
so no window lies wholly inside the one before it, and a text of at most
``length`` tokens is one passage.  The default tokenizer splits on white
space (``str.split``) and joins with single spaces; a sub-word tokenizer
can be plugged in (K2).

Scoring hooks (K3):

* ``coverage_scores`` - the SQL-expressible default pair scorer, a labelled
  stand-in for a cross-encoder: ``sum idf(t) over query terms found in the
  passage / sum idf(t) over query terms``, ``idf = log2(N / df + 1)``, terms
  outside the lexicon ignored;
* ``model_scores`` - any caller-supplied ``score_fn(queries, texts)``, run in
  Arrow batches of ``batch_size`` pairs with ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import split_words
from quarry.operators.index import Index, term_bucket
from quarry.operators.util import (SCORE_DECIMALS, broadcast_if_small, one_array, ranges, round_score, round_scores,
                                   stored, top_k)

LENGTH, STRIDE = 256, 128
BATCH_SIZE = 16
BLOCK_TOKENS = 1 << 23      # index tokens of the documents that a group of ``top_passages`` scores, on average
PASSAGES = 1 << 14          # whose terms are looked up at a time
LOOKUPS = 1 << 20           # terms of (query, document) pairs that are looked up at a time


def whitespace_tokens(c: Column) -> Column:
    return split_words(c)


def window_starts(n: Column, length: int = LENGTH, stride: int = STRIDE) -> Column:
    """Start offsets (0-based) of the sliding windows over ``n`` tokens."""
    last = F.greatest(n - (length - stride) - 1, F.lit(0))
    return F.sequence(F.lit(0), last, F.lit(stride))


def sliding(df: DataFrame, length: int = LENGTH, stride: int = STRIDE, text: str = "text",
            tokenize: Callable[[Column], Column] = whitespace_tokens,
            detokenize: Callable[[Column], Column] | None = None,
            prepend_attr: str | None = None) -> DataFrame:
    """One row per passage, ``passage_no`` from 0; other columns kept.

    ``prepend_attr`` puts that column's value (e.g. a title) before each
    passage, separated by a space.
    """
    detok = detokenize or (lambda c: F.array_join(c, " "))
    toks = tokenize(F.col(text))
    out = (df.withColumn("_toks", toks)
           .select("*", F.posexplode(window_starts(F.size("_toks"), length, stride))
                   .alias("passage_no", "_start"))
           .withColumn(text, detok(F.slice("_toks", F.col("_start") + 1, length))))
    if prepend_attr:
        out = out.withColumn(text, F.concat_ws(" ", F.col(prepend_attr), F.col(text)))
    return out.drop("_toks", "_start")


def run_passages(run: DataFrame, index: Index, length: int = LENGTH, stride: int = STRIDE,
                 field: str = "text", with_terms: bool = True) -> DataFrame:
    """H11 first half: ``run % k >> get_text >> sliding`` as
    ``(<run columns>, passage_no, text[, terms])``.

    Passages depend only on the document, so they are cut once per distinct
    retrieved document (with their distinct index terms when
    ``with_terms``) and joined back to the run by ``docno`` - a document
    retrieved by many queries is tokenised once, not once per query.
    """
    from quarry.operators.index import get_text
    run = stored(run, "run")
    ids = run.select("docno").distinct()
    ps = sliding(get_text(ids, index, field), length, stride)
    if with_terms:
        ps = ps.withColumn("terms", F.array_distinct(index.terms(F.col("text"))))
    return run.drop("text").join(ps, "docno")


def query_idf_maps(topics: DataFrame, index: Index, query: str = "query") -> DataFrame:
    """``(qid, qmap map<term, idf>, total)`` for the coverage scorer; one
    row per query, so it is broadcast after a size check."""
    qt = (topics.select("qid", F.explode(F.array_distinct(index.terms(F.col(query)))).alias("term"))
          .withColumn("term_bucket", term_bucket("term", index.term_buckets)))
    qt = broadcast_if_small(qt)
    n = float(index.n_docs)
    qw = (qt.join(index.lexicon.select("term_bucket", "term", "df"), ["term_bucket", "term"])
          .select("qid", "term", F.log2(F.lit(n) / F.col("df").cast("double") + 1.0).alias("idf")))
    return qw.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("qmap"),
                                 F.sum("idf").alias("total"))


def coverage_scores(passages: DataFrame, topics: DataFrame, index: Index,
                    query: str = "query", text: str = "text") -> DataFrame:
    """H9 default scorer: adds ``score`` to ``passages(qid, ..., text)``.

    Each row intersects its terms with its query's terms (a hash-based set
    operation) and looks up idf only for the matches - one pass, no explode
    and no shuffle of the passages.
    """
    maps = broadcast_if_small(query_idf_maps(topics, index, query))
    terms = F.col("terms") if "terms" in passages.columns else index.terms(F.col(text))
    found = F.aggregate(F.array_intersect(terms, F.map_keys("qmap")), F.lit(0.0),
                        lambda acc, t: acc + F.try_element_at(F.col("qmap"), t))
    return (passages.join(maps, "qid", "left")
            .withColumn("score", round_score(F.coalesce(F.try_divide(found, F.col("total")), F.lit(0.0))))
            .drop("qmap", "total", "terms"))


def model_scores(pairs: DataFrame, score_fn: Callable[[list[str], list[str]], list[float]],
                 batch_size: int = BATCH_SIZE, query: str = "query", text: str = "text") -> DataFrame:
    """H9 with a caller-supplied pair scorer (e.g. a cross-encoder), called
    on batches of ``batch_size`` (query, text) pairs per Arrow batch."""
    schema = T.StructType(list(pairs.schema.fields) + [T.StructField("score", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            scores = []
            for i in range(0, len(pdf), batch_size):
                part = pdf.iloc[i:i + batch_size]
                scores.extend(score_fn(part[query].fillna("").tolist(), part[text].fillna("").tolist()))
            yield pdf.assign(score=pd.Series(scores, index=pdf.index, dtype="float64").round(SCORE_DECIMALS))

    return pairs.mapInPandas(run, schema)


def max_passage(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Per (qid, docno) the best passage's score and text (ties: the
    earlier passage), re-ranked ``(qid, docno, score, text, rank)``."""
    best = (scored.groupBy("qid", "docno")
            .agg(F.max_by(F.struct("score", "text"),
                          F.struct("score", (-F.col("passage_no")).alias("p"))).alias("b"))
            .select("qid", "docno", "b.score", "b.text"))
    return top_k(best, k).select("qid", "docno", "score", "text", "rank")


def _best_passages(passages: pa.Table, asked: pa.Table) -> pa.Table:
    """The best passage of each (query, document) pair of a block, as
    ``max_passage(coverage_scores(...))`` finds it, before ranking.

    ``passages(docno, passage_no, same, terms)``, ``asked(qid, docnos, terms,
    idfs, total)``; terms are lists, or joined by spaces.  They are looked up by
    document, so a passage costs something only where it holds a query term."""
    schema = pa.schema([("qid", asked.schema.field("qid").type), ("docno", passages.schema.field("docno").type),
                        ("score", pa.float64()), ("passage_no", pa.int32()), ("same", pa.int64())])
    if not passages.num_rows or not asked.num_rows:
        return schema.empty_table()
    coded = one_array(passages["docno"]).dictionary_encode()
    ids, doc = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((passages["passage_no"].to_numpy(), doc))
    passages, doc = passages.take(pa.array(order)), doc[order]
    many = np.bincount(doc, minlength=len(ids))         # passages of each document, from ``base`` on
    base = np.cumsum(many) - many

    split = lambda column: column if pa.types.is_list(column.type) else pc.split_pattern(column, " ")                          # noqa: E731
    lists = split(one_array(asked["terms"]))                        # null: a query without known terms
    words = pc.unique(lists.flatten())
    place = lambda column: pc.index_in(column, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)                   # noqa: E731
    lengths = lambda column: pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)         # noqa: E731

    # (document, term) -> the passages that hold it
    keys, rows = [], []
    for at in range(0, len(doc), PASSAGES):
        held = split(one_array(passages["terms"].slice(at, PASSAGES)))
        term, row = place(held.flatten()), np.repeat(np.arange(at, at + len(held), dtype=np.int32), lengths(held))
        row, term = row[term >= 0], term[term >= 0]
        keys.append(doc[row] * len(words) + term)
        rows.append(row)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(key, kind="stable")
    row = row[order]
    key, begin, count = np.unique(key[order], return_index=True, return_counts=True)

    term, idf = place(lists.flatten()), one_array(asked["idfs"]).flatten().to_numpy(zero_copy_only=False)
    of_query = lengths(lists)
    first = np.cumsum(of_query) - of_query
    total = asked["total"].to_numpy()
    docnos = one_array(asked["docnos"])
    q = np.repeat(np.arange(asked.num_rows), lengths(docnos))
    d = pc.index_in(docnos.flatten(), value_set=ids).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    q, d = q[d >= 0], d[d >= 0]
    scores, best = np.zeros(len(q)), np.zeros(len(q), np.int64)
    work = np.cumsum(of_query[q] + many[d])
    cuts = np.searchsorted(work, np.arange(LOOKUPS, work[-1] if len(work) else 0, LOOKUPS))
    for lo, hi in zip([0, *cuts], [*cuts, len(q)]):
        if lo == hi:
            continue
        mq, md = q[lo:hi], d[lo:hi]
        slots = np.cumsum(many[md]) - many[md]
        pair, at = ranges(first[mq], of_query[mq])
        wanted = md[pair] * len(words) + term[at]
        found = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
        hit = key[found] == wanted if len(key) else np.zeros(len(wanted), bool)
        pair, at, found = pair[hit], at[hit], found[hit]
        n, posting = ranges(begin[found], count[found])
        slot = slots[pair[n]] + row[posting] - base[md[pair[n]]]
        size = int(many[md].sum())
        sums = np.bincount(slot, weights=idf[at[n]], minlength=size)
        of = np.repeat(np.arange(len(mq)), many[md])
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.nan_to_num(round_scores(sums / total[mq][of]), nan=0.0, posinf=0.0, neginf=0.0)
        scores[lo:hi] = np.maximum.reduceat(s, slots)
        place_ = np.where(s == scores[lo:hi][of], np.arange(size), size)
        best[lo:hi] = base[md] + np.minimum.reduceat(place_, slots) - slots     # the earliest of the best
    got = passages.select(["passage_no", "same"]).take(pa.array(best))
    return pa.table([one_array(asked["qid"]).take(pa.array(q)), ids.take(pa.array(d)), pa.array(scores),
                     one_array(got["passage_no"]).cast(pa.int32()), one_array(got["same"])], schema=schema)


def top_passages(run: DataFrame, topics: DataFrame, index: Index, n: int, length: int = LENGTH,
                 stride: int = STRIDE, field: str = "text") -> DataFrame:
    """The ``n`` best rows a query of ``max_passage(coverage_scores(run_passages(run)))``.

    All passages of the run are scored by their terms, a block of documents and
    all that was asked of it at a time; only those returned meet their text, so the
    text of a document does not travel once for each query that found it.  A
    query's terms travel once for each block that holds a document of its run, so
    blocks are large and terms are one string."""
    from quarry.operators.index import get_text
    run = stored(run, "run")

    def cut(ids):
        return (sliding(get_text(ids.select("docno").distinct(), index, field), length, stride)
                .withColumn("same", F.xxhash64("text")))       # tells texts apart where an id repeats

    blocks = max(int(run.sparkSession.sparkContext.defaultParallelism), -(-index.n_tokens // BLOCK_TOKENS))
    block = F.pmod(F.xxhash64("docno"), F.lit(blocks)).cast("int").alias("block")
    known = F.col("docno").isNotNull()
    terms = cut(run).filter(known).select(block, "docno", "passage_no", "same",
                                          F.array_join(F.array_distinct(index.terms(F.col("text"))), " ").alias("terms"))
    maps = query_idf_maps(topics, index).select("qid", F.array_join(F.map_keys("qmap"), " ").alias("terms"),
                                                F.map_values("qmap").alias("idfs"), "total")
    asked = (run.filter(known).groupBy("qid", block).agg(F.collect_list("docno").alias("docnos"))
             .join(broadcast_if_small(maps), "qid", "left")
             .select("block", "qid", "docnos", "terms", "idfs", F.coalesce("total", F.lit(0.0)).alias("total")))
    kinds = ", ".join(f"{c} {run.schema[c].dataType.simpleString()}" for c in ("qid", "docno"))

    def score(passages, asked_):
        return _best_passages(passages.select(["docno", "passage_no", "same", "terms"]),
                              asked_.select(["qid", "docnos", "terms", "idfs", "total"]))

    best = (terms.groupBy("block").cogroup(asked.groupBy("block"))
            .applyInArrow(score, f"{kinds}, score double, passage_no int, same long"))
    top = stored(top_k(best, n), "top")
    return (top.join(cut(top).select("docno", "passage_no", "same", "text"), ["docno", "passage_no", "same"])
            .dropDuplicates(["qid", "docno"]).select("qid", "docno", "score", "text", "rank"))
