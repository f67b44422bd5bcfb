"""Dense vectors, exhaustive retrieval and re-ranking.

Exhaustive retrieval (C6/H7) scores every query against every document.
Emitting those pairs as rows would not scale, so documents and queries are
dealt into blocks of bounded size by hash of their id.  Each pair of blocks is
one task, which holds its queries and their best so far while its documents
stream past: a blocked matrix product, of which only scores above a query's k-th
are looked at.  Where queries are many, a task meets all documents and its
ranks are final; else the top-k per query merges those of the tasks.  Neither
side passes through the driver or is broadcast.

Scores are dot products in double precision, rounded to 6 decimals before
ranking; ties go to the smaller ``docno``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.operators.util import BROADCAST_MAX_BYTES, SCORE_DECIMALS, broadcast_if_small, one_array, top_k

DEPTH = 1000
HASHED_DIMS = 64
COMMON_BYTES = BROADCAST_MAX_BYTES       # of the lexicon's common terms, which go to the postings
DOC_BLOCK, QUERY_BLOCK = 1 << 20, 16_384    # vectors of a task, on average
BLOCK_ROWS, BLOCK_QUERIES = 2_048, 512   # those of one matrix product inside it


def dot(a, b):
    """Dot product of two ``array<float|double>`` columns, in double."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda s, x: s + x)


def encode(docs: DataFrame, encode_fn: Callable[[list[str]], list[list[float]]],
           id_col: str = "docno", text: str = "text", batch_size: int = 64) -> DataFrame:
    """``(id, vec array<float>)`` by a caller-supplied encoder, run in
    Arrow batches with ``mapInPandas`` (the model loads once per worker if
    ``encode_fn`` caches it)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch_size):
                part = pdf.iloc[i:i + batch_size]
                vecs = encode_fn(part[text].fillna("").tolist())
                yield pd.DataFrame({id_col: part[id_col].values,
                                    "vec": [list(map(float, v)) for v in vecs]})

    return docs.select(id_col, text).mapInPandas(run, f"{id_col} {id_type}, vec array<float>")


def hashed_encoder(dims: int = 64, text_tokens=None):
    """Stand-in encoder (no model weights): hashed term counts, L2-normalised.
    Labelled a stand-in; it does not reproduce a neural encoder."""
    import re
    import zlib
    pat = re.compile(r"[^\W_]+", re.UNICODE)

    def fn(texts):
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in pat.findall(t.lower()):
                v[zlib.crc32(w.encode()) % dims] += 1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out
    return fn


def _dim(term, dims: int):
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 4), 16, 10).cast("int"), F.lit(dims))


def _sign(term):
    return F.when(F.conv(F.substring(F.md5(term), 5, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def _weighted(lexicon: DataFrame, n_docs: int, dims: int) -> DataFrame:
    """Terms with ``dim``, their place, and ``w``, their idf with its sign."""
    idf = F.log2(F.lit(float(n_docs)) / F.col("df") + 1.0)
    return lexicon.withColumn("dim", _dim(F.col("term"), dims)).withColumn("w", idf * _sign(F.col("term"))).drop("df")


def _common_from(lexicon: DataFrame, max_bytes: int) -> tuple[int | None, bool]:
    """The least power of two so that the terms of at least that document
    frequency are small enough to broadcast (``None``: no such terms), and
    whether those are all terms."""
    steps = (lexicon.groupBy(F.floor(F.log2("df")).cast("int").alias("step"))
             .agg(F.sum(F.octet_length("term") + 24).alias("size")).collect())       # one a power of two
    size, least = 0, None
    for r in sorted(steps, key=lambda r: -r.step):
        size += r["size"]
        if size > max_bytes:
            return least, False
        least = 2 ** r.step
    return least, True


def hashed_vectors(ids: DataFrame, terms: DataFrame, index, id_col: str, dims: int = HASHED_DIMS,
                   few: bool = False) -> DataFrame:
    """H6 without model weights: ``(id, vec array<double>)`` for every row of
    ``ids`` from ``terms(id, term, tf)``.

    Each term falls on one of ``dims`` places with a sign, both by its MD5, and
    counts ``tf * log2(N / df + 1)``; the vector is normalised and rounded.
    Texts without known terms get the zero vector.  A labelled stand-in: it is
    made in Spark and SQL can repeat it, but it is no neural encoder.

    With ``few`` terms those go to the lexicon.  Otherwise the common terms of the
    lexicon go to ``terms``, and only rows of rare ones (most terms, but few
    rows) are shuffled to meet it."""
    lex = index.lexicon.select("term", "df")
    if few:
        met = [_weighted(broadcast_if_small(terms).join(lex, "term"), index.n_docs, dims)]
    else:
        least, whole = _common_from(lex, COMMON_BYTES)
        common = _weighted(lex if least is None else lex.filter(F.col("df") >= least), index.n_docs, dims)
        if whole:
            met = [terms.join(F.broadcast(common), "term")]
        elif least is None:
            met = [terms.join(common, "term")]
        else:
            rare = _weighted(lex.filter(F.col("df") < least), index.n_docs, dims)
            met = [terms.join(F.broadcast(common), "term"),
                   terms.join(F.broadcast(common.select("term")), "term", "left_anti").join(rare.hint("merge"), "term")]
    out = ids.select(id_col)
    for i, rows in enumerate(met):
        at = (rows.groupBy(id_col, "dim").agg(F.sum(F.col("tf").cast("double") * F.col("w")).alias("x"))
              .groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias(f"at{i}")))
        out = out.join(at, id_col, "left")
    place = lambda i: sum((F.coalesce(F.try_element_at(f"at{j}", i), F.lit(0.0)) for j in range(len(met))), F.lit(0.0))
    return (out.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), place).alias("x"))
            .withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)))
            .select(id_col, F.transform("x", lambda x: F.round(F.coalesce(
                F.try_divide(x, F.col("norm")), F.lit(0.0)), SCORE_DECIMALS) + F.lit(0.0)).alias("vec")))


def document_vectors(index, field: int = 0, dims: int = HASHED_DIMS) -> DataFrame:
    """``(docno, vec)`` of every indexed document; but for rare terms of a large
    lexicon the work stays in the index's buckets."""
    post = index.postings.filter(F.col("field") == field).select("docno", "term", "tf")
    return hashed_vectors(index.doc_stats.filter(F.col("field") == field), post, index, "docno", dims)


def query_vectors(topics: DataFrame, index, dims: int = HASHED_DIMS) -> DataFrame:
    """``(qid, vec)`` of every topic by the index's own term rule."""
    from quarry.operators.retrieve import query_terms
    return hashed_vectors(topics, query_terms(topics, index).withColumnRenamed("weight", "tf"), index, "qid", dims, few=True)


class _Best:
    """The best ``k`` documents so far of some queries, by place: documents come
    in the order of their ids, so of equal scores the earlier place wins.  What is
    no number comes after all numbers."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.s, self.p = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), np.int32)
        self.least = None               # the k-th score, once there are k
        self.waiting, self.waiting_rows = [], 0

    def _keep(self, s: np.ndarray, p: np.ndarray) -> None:
        """The best ``k`` of each row, left in their order."""
        if s.shape[1] >= self.k:
            key = np.where(np.isnan(s), -np.inf, s)
            least = np.partition(key, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            more, as_good = key > least[:, None], key == least[:, None]
            room = self.k - more.sum(axis=1)
            keep = more | (as_good & (np.cumsum(as_good, axis=1) <= room[:, None]))
            s, p, self.least = s[keep].reshape(len(s), self.k), p[keep].reshape(len(s), self.k), least
        self.s, self.p = s, p

    def meet(self, docs: np.ndarray, place: int) -> None:
        """Documents ``place ..`` are scored."""
        scores = self.queries @ docs.T
        if self.least is None:
            places = np.broadcast_to(np.arange(place, place + len(docs), dtype=np.int32), scores.shape)
            self._keep(np.concatenate([self.s, np.round(scores, SCORE_DECIMALS)], axis=1),
                       np.concatenate([self.p, places], axis=1))
            return
        row, at = np.nonzero(~(scores < (self.least - 2 * 10.0 ** -SCORE_DECIMALS)[:, None]))
        s = np.round(scores[row, at], SCORE_DECIMALS)
        better = s > self.least[row]
        if not np.isfinite(self.least).all():
            better |= ~np.isfinite(self.least[row]) & np.isfinite(s)
        if better.any():
            self.waiting.append((row[better].astype(np.int32), (at[better] + place).astype(np.int32), s[better]))
            self.waiting_rows += len(self.waiting[-1][0])
            if self.waiting_rows > self.s.size // 2:
                self.settle()

    def settle(self) -> None:
        """What waits is put beside the best, as many columns as a row needs."""
        if not self.waiting:
            return
        row, p, s = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.waiting_rows = [], 0
        order = np.argsort(row, kind="stable")
        row, p, s = row[order], p[order], s[order]
        many = np.bincount(row, minlength=len(self.s))
        column = np.arange(len(row)) - (np.cumsum(many) - many)[row]
        more_s, more_p = np.full((len(self.s), many.max()), np.nan), np.zeros((len(self.s), many.max()), np.int32)
        more_s[row, column], more_p[row, column] = s, p
        self._keep(np.concatenate([self.s, more_s], axis=1), np.concatenate([self.p, more_p], axis=1))

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places by falling score, as Spark sorts (what is no number first)."""
        self.settle()
        order = np.argsort(-np.where(np.isnan(self.s), np.inf, self.s), axis=1, kind="stable")
        return np.take_along_axis(self.s, order, axis=1), np.take_along_axis(self.p, order, axis=1)


def _matrix(column) -> np.ndarray:
    lists = one_array(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dims = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))
    if len(dims) > 1:
        raise ValueError(f"vectors of {len(dims)} lengths, from {dims[0]} to {dims[-1]}")
    return flat.reshape(len(lists), int(dims[0]) if len(dims) else 0)


def _searched(k: int, schema: pa.Schema):
    """Function of a task's rows ``(g, kind, qid, docno, vec)``, of each group its
    queries (kind 0) before its documents: ranked rows."""
    def results(asked, best, ids):
        if not best or not ids:
            return
        qids, ids = one_array(pa.chunked_array(asked)), one_array(pa.chunked_array(ids))
        coded = one_array(qids.dictionary_encode(null_encoding="encode"))
        code, many = coded.indices.to_numpy(), np.bincount(coded.indices.to_numpy())
        repeated: dict[int, list] = {}
        rows = lambda q, p, s, rank: pa.RecordBatch.from_arrays(                               # noqa: E731
            [one_array(qids.take(pa.array(q))), one_array(ids.take(pa.array(p))), pa.array(s), pa.array(rank, pa.int32())], schema=schema)
        at = 0
        for b in best:
            s, p = b.ranked()
            own = np.arange(at, at + len(s))
            once = many[code[own]] == 1
            for i in np.flatnonzero(~once):
                repeated.setdefault(code[own[i]], []).append((own[i], s[i], p[i]))
            if once.any():
                yield rows(np.repeat(own[once], s.shape[1]), p[once].ravel(), s[once].ravel(),
                           np.tile(np.arange(1, s.shape[1] + 1), once.sum()))
            at += len(s)
        for lists in repeated.values():         # queries of one id count as one
            s, p = np.concatenate([x[1] for x in lists]), np.concatenate([x[2] for x in lists])
            order = np.lexsort((p, -np.where(np.isnan(s), np.inf, s)))[:k]
            yield rows(np.full(len(order), lists[0][0]), p[order], s[order], np.arange(1, len(order) + 1))

    def run(batches):
        group, asked, vecs, best, ids, place = None, [], [], [], [], 0
        for batch in batches:
            g, kind = (batch.column(c).to_numpy() for c in (0, 1))
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(g)]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if g[lo] != group:
                    yield from results(asked, best, ids)
                    group, asked, vecs, best, ids, place = g[lo], [], [], [], [], 0
                m = _matrix(part.column(4))
                if not kind[lo]:
                    asked.append(part.column(2))
                    vecs.append(m)
                    continue
                if vecs:
                    q, vecs = np.concatenate(vecs), []
                    best = [_Best(q[i:i + BLOCK_QUERIES], k) for i in range(0, len(q), BLOCK_QUERIES)]
                ids.append(part.column(3))
                for i in range(0, len(m), BLOCK_ROWS):
                    for b in best:
                        b.meet(m[i:i + BLOCK_ROWS], place + i)
                place += len(m)
        yield from results(asked, best, ids)
    return run


def exhaustive_topk(docs: DataFrame, queries: DataFrame, k: int = DEPTH,
                    doc_id: str = "docno", doc_vec: str = "vec",
                    qid: str = "qid", q_vec: str = "vec") -> DataFrame:
    """C6 + H7: top ``k`` documents per query by dot product
    ``(qid, docno, score, rank)``.

    A document travels once for each block of queries, a query once for each
    block of documents, and of these there is one where queries are many."""
    d = docs.select(F.col(doc_id).alias("docno"), F.col(doc_vec).alias("vec")).filter("vec is not null")
    q = queries.select(F.col(qid).alias("qid"), F.col(q_vec).alias("vec")).filter("vec is not null")
    n_d, n_q = d.count(), q.count()
    cores = int(docs.sparkSession.sparkContext.defaultParallelism)
    q_blocks = max(1, -(-n_q // QUERY_BLOCK), min(cores, n_q // BLOCK_QUERIES))
    q_blocks = q_blocks if q_blocks <= cores else -(-q_blocks // cores) * cores          # tasks are equal, so whole rounds
    d_blocks = max(1, -(-n_d // DOC_BLOCK), -(-cores // q_blocks))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")                     # noqa: E731
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))                       # noqa: E731
    id_type, q_type, vec = d.schema["docno"].dataType, q.schema["qid"].dataType, d.schema["vec"].dataType
    vec = vec if vec == q.schema["vec"].dataType else T.ArrayType(T.DoubleType())
    g = (F.col("qb") * d_blocks + F.col("db")).alias("g")
    d = (d.select("docno", "vec", block("docno", d_blocks).alias("db"), each(q_blocks).alias("qb"))
         .select(g, F.lit(1).alias("kind"), F.lit(None).cast(q_type).alias("qid"), "docno", F.col("vec").cast(vec).alias("vec")))
    q = (q.select("qid", "vec", block("qid", q_blocks).alias("qb"), each(d_blocks).alias("db"))
         .select(g, F.lit(0).alias("kind"), "qid", F.lit(None).cast(id_type).alias("docno"), F.col("vec").cast(vec).alias("vec")))
    out = T.StructType([T.StructField("qid", q_type), T.StructField("docno", id_type),
                        T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    found = (d.unionByName(q).repartitionById(q_blocks * d_blocks, "g").sortWithinPartitions("g", "kind", "docno")
             .mapInArrow(_searched(k, to_arrow_schema(out)), out))
    if d_blocks == 1:
        return found
    return top_k(found.drop("rank"), k, parts=d_blocks).select("qid", "docno", "score", "rank")


def rerank(run: DataFrame, doc_vectors: DataFrame, query_vectors: DataFrame,
           k: int | None = None, doc_id: str = "docno", qid: str = "qid",
           vec: str = "vec") -> DataFrame:
    """C5 + H8: re-score a run's (qid, docno) pairs by dot product; pairs
    whose document or query has no vector are dropped."""
    dv = doc_vectors.select(F.col(doc_id).alias("docno"), F.col(vec).alias("dvec"))
    qv = broadcast_if_small(query_vectors.select(F.col(qid).alias("qid"), F.col(vec).alias("qvec")))
    scored = (run.select("qid", "docno").join(dv, "docno").join(qv, "qid")
              .select("qid", "docno", F.round(dot("qvec", "dvec"), SCORE_DECIMALS).alias("score")))
    return top_k(scored, k).select("qid", "docno", "score", "rank")


def build_dense_index(docs: DataFrame, path: str, encode_fn: Callable[[list[str]], list[list[float]]],
                      doc_id: str = "docno", text: str = "text", mode: str = "errorifexists",
                      batch_size: int = 64, buckets: int | None = None) -> DataFrame:
    """Encode every document and store ``(docno, vec)`` as Parquet
    bucketed by ``docno`` (so re-ranking joins shuffle only the run).
    ``mode``: ``errorifexists`` (create-or-fail) or ``overwrite``."""
    vec = encode(docs.select(F.col(doc_id).alias("docno"), F.col(text).alias("text")), encode_fn,
                 "docno", "text", batch_size)
    return store_vectors(vec, path, mode, buckets, source=docs)


def store_vectors(vec: DataFrame, path: str, mode: str = "errorifexists", buckets: int | None = None,
                  source: DataFrame | None = None) -> DataFrame:
    """A dense index from ``(docno, vec)``; ``source`` is the table whose
    size sets the number of buckets."""
    from quarry.operators.index import _delete, _table_name, auto_doc_buckets
    from quarry.session import path_exists
    spark = vec.sparkSession
    if path_exists(spark, path):
        if mode == "errorifexists":
            raise RuntimeError(f"there are vectors at {path} already; pass mode='overwrite' to replace them")
        _delete(spark, path)
    B = int(buckets or auto_doc_buckets(vec if source is None else source))
    name = _table_name(path, "vectors")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (vec.repartition(B, "docno").write.format("parquet").bucketBy(B, "docno").sortBy("docno")
        .option("path", path).saveAsTable(name))
    meta = json.dumps({"buckets": B, "docno_type": vec.schema["docno"].dataType.simpleString(),
                       "vec_type": vec.schema["vec"].dataType.simpleString()})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")
    return open_dense_index(spark, path)


def open_dense_index(spark, path: str) -> DataFrame:
    """``(docno, vec)`` of a stored dense index or ``RuntimeError``."""
    from quarry.operators.index import _table_name
    from quarry.session import path_exists
    if not path_exists(spark, path):
        raise RuntimeError(f"no vectors at {path}")
    name = _table_name(path, "vectors")
    if not spark.catalog.tableExists(name):
        meta = json.loads(spark.read.text(f"{path}/_meta").first()[0])
        spark.sql(f"CREATE TABLE {name} (docno {meta['docno_type']}, vec {meta['vec_type']}) USING parquet "
                  f"CLUSTERED BY (docno) SORTED BY (docno) INTO {meta['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)
