"""Exact top-k search by inner product over vectors sorted by length.

Components become integers, so scores are exact.

1. Vectors of one dimension are numbered by falling length and cut into ranges
   of bounded size; queries are dealt into blocks of bounded size.
2. Every block of queries meets the range of the longest vectors.  The k-th
   score found there is a query's first threshold.
3. A query goes on only to ranges whose longest vector times its own length
   can reach its threshold, and a range is copied only for blocks that hold
   such a query.
4. A block and a range are one piece of work (``search``): principal axes of
   the range (singular value decomposition) rotate both sides; candidates come
   in slabs by falling length.  For each slab a partial sum over the first axes
   plus the product of the remaining lengths (Cauchy-Schwarz) bounds the score.
   Pairs below the query's threshold go, the others get a longer partial sum,
   and what is left its exact score.  Work ends when no query's length times
   that of the next slab can reach its threshold.
5. The best of a query's pieces are merged, ties to the smaller ``vec_id``.

A bound is dropped only if it is below the threshold by more than rounding can
explain, so results are exact.  A vector that is null or empty, or holds null
or non-finite components, takes no part; neither does one whose squared
integer length reaches 2**62, as its scores need not fit a long.  Only vectors
of equal dimension are compared.  Rows that share the query's ``vec_id`` are
not its candidates; otherwise repeated rows are candidates, and queries, each
on its own.  Rows without ``vec_id`` are candidates only, after the others in
a tie.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered

RANGE_VALUES = 1 << 22      # components of a range, at most
BLOCK_VALUES = 1 << 19      # components of a block of queries, on average
SLABS = (64, 128, 256, 512)     # candidates of the first slabs; the last size goes on
PAIRS = 1 << 16             # pairs that are summed at a time
LONGEST = float(1 << 62)
ROUNDING = 1e-10            # of a score relative to the lengths' product
FOUND = "dim int, qpos long, query_id long, vec_id long, score long"
_FOUND = pa.schema([("dim", pa.int32()), ("qpos", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return x.reshape(rows, -1)


def _slabs(n: int):
    start, turn = 0, 0
    while start < n:
        size = SLABS[min(turn, len(SLABS) - 1)]
        yield start, min(n, start + size)
        start, turn = start + size, turn + 1


def _pair_sums(a, i, b, j):
    """Sums of products of rows ``i`` of ``a`` with rows ``j`` of ``b``."""
    parts = [np.einsum("ij,ij->i", a[i[s:s + PAIRS]], b[j[s:s + PAIRS]]) for s in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, a.dtype)


def search(x: np.ndarray, ids: np.ndarray, known: np.ndarray, queries: np.ndarray, own: np.ndarray,
           least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, candidate row, score)`` of the ``k`` best candidates of
    each query, of those that reach ``least``.  ``known`` tells which ``ids``
    are not null."""
    n, m = len(x), len(queries)
    xf, qf = x.astype(np.float64), queries.astype(np.float64)
    length, qlength = np.sqrt((xf * xf).sum(1)), np.sqrt((qf * qf).sum(1))
    tie = np.empty(n, np.int64)
    tie[np.lexsort((ids, ~known))] = np.arange(n)
    by_tie = np.argsort(tie)
    order = np.argsort(-length, kind="stable")
    axes = np.linalg.eigh(xf.T @ xf)[1][:, ::-1]         # right singular vectors, falling
    y, qy = xf @ axes, qf @ axes
    short = max(1, x.shape[1] // 8)
    longer = max(short, x.shape[1] // 2)
    rest = {h: (np.sqrt((y[:, h:] ** 2).sum(1)), np.sqrt((qy[:, h:] ** 2).sum(1))) for h in (short, longer)}
    dense_is_exact = length.max(initial=0) * qlength.max(initial=0) < float(1 << 52)

    best = np.full((m, k), np.iinfo(np.int64).min)
    best_tie = np.full((m, k), n)                        # n: no candidate
    limit = least.copy()
    for start, end in _slabs(n):
        rows = order[start:end]
        live = np.flatnonzero(qlength * length[rows[0]] * (1 + ROUNDING) + 1e-6 >= limit)
        if not len(live):
            break
        r, qr = rest[short]
        bound = qy[live, :short] @ y[rows, :short].T + np.multiply.outer(qr[live], r[rows])
        slack = np.multiply.outer(qlength[live], length[rows]) * ROUNDING + 1e-6
        i, j = np.nonzero((bound + slack >= limit[live][:, None]) & ((own[live][:, None] != ids[rows]) | ~known[rows]))
        if len(i) * 8 > bound.size and dense_is_exact:
            score = (qf[live] @ xf[rows].T)[i, j].astype(np.int64)
            i, j = live[i], rows[j]
        else:
            i, j = live[i], rows[j]
            r, qr = rest[longer]
            bound = _pair_sums(qy[:, :longer], i, y[:, :longer], j) + qr[i] * r[j]
            near = bound + qlength[i] * length[j] * ROUNDING + 1e-6 >= limit[i]
            i, j = i[near], j[near]
            score = _pair_sums(queries, i, x, j)
        enough = score >= limit[i]
        i, j, score = i[enough], j[enough], score[enough]
        if not len(i):
            continue
        hit = np.unique(i)
        who = np.concatenate([np.repeat(hit, k), i])
        what = np.concatenate([best_tie[hit].ravel(), tie[j]])
        much = np.concatenate([best[hit].ravel(), score])
        at = np.lexsort((what, ~much, who))
        who, what, much = who[at], what[at], much[at]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        top = place < k
        best[who[top], place[top]] = much[top]
        best_tie[who[top], place[top]] = what[top]
        full = hit[best_tie[hit, k - 1] < n]
        last = best[full, k - 1].astype(np.float64)
        limit[full] = np.maximum(limit[full], last - np.abs(last) * 1e-12)
    q, place = np.nonzero(best_tie < n)
    return q, by_tie[best_tie[q, place]], best[q, place]


def _searched(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``FOUND`` rows of each piece of work ``(dim, rng, qb)``."""
    def work(c: pa.Table, q: pa.Table) -> pa.Table:
        if not c.num_rows or not q.num_rows:
            return _FOUND.empty_table()
        ids = c.column("id")
        known = ids.is_valid().to_numpy()
        ids = ids.fill_null(0).to_numpy()
        own = q.column("id").to_numpy()
        least = q.column("least").cast(pa.float64(), safe=False).fill_null(float("-inf")).to_numpy()
        least = least - np.where(np.isfinite(least), np.abs(least), 0.0) * 1e-12
        x = _matrix(c.column("x"), c.num_rows)
        i, j, score = search(x, ids, known, _matrix(q.column("x"), q.num_rows), own, least, k)
        return pa.table([pa.array(np.full(len(i), x.shape[1]), pa.int32()), pa.array(q.column("pos").to_numpy()[i]),
                         pa.array(own[i]), pa.array(ids[j], mask=~known[j]), pa.array(score)], schema=_FOUND)

    keys = ["dim", "rng", "qb"]
    both = [F.col(c).alias(c) for c in (*keys, "id", "x")]      # names of its own: both come from one table
    return (candidates.select(*both).groupBy(*keys)
            .cogroup(queries.select(*keys, "id", "pos", "least", "x").groupBy(*keys)).applyInArrow(work, FOUND))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0,
          key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best candidates of every
    row where ``is_query`` (a condition on ``id``, the row's key) holds, by the
    inner product of floor(scale * component)."""
    v, x = F.col("v"), F.col("x")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = (rows.filter(sound)
            .select("id", F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c)).alias("x"))
            .withColumn("sq", F.aggregate(x, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
            .filter(F.col("sq") < LONGEST)
            .select("id", "x", "sq", F.size(x).alias("dim"), (-F.col("sq")).alias("shortness")))
    rows = numbered(rows, ["dim"], ["shortness", "id"]).drop("shortness")

    asked = F.coalesce(is_query, F.lit(False))
    pieces = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    size = F.greatest(F.lit(1), F.least(F.expr(f"{RANGE_VALUES} div dim"), F.ceil(F.col("of") / pieces)))
    rows = rows.withColumn("asked", asked).withColumn("rng", F.floor(F.col("pos") / size))
    blocks = (rows.filter("asked").groupBy("dim").agg(F.count(F.lit(1)).alias("m"))
              .select("dim", F.greatest(F.lit(1), F.ceil(F.col("m") * F.col("dim") / BLOCK_VALUES)).alias("blocks")))
    queries = (rows.filter("asked").join(blocks, "dim")
               .select("dim", "id", "pos", "x", "sq", F.pmod(F.xxhash64("pos"), F.col("blocks")).alias("qb")))
    zero = F.lit(0).cast("long")

    longest = (rows.filter("rng = 0").join(blocks, "dim")
               .select("dim", "rng", "id", "x", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("qb")))
    first = cut(_searched(longest, queries.withColumn("rng", zero).withColumn("least", F.lit(None).cast("long")), k))

    least = (first.groupBy("dim", F.col("qpos").alias("pos"))
             .agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least")))
    ranges = rows.filter("rng > 0").groupBy("dim", "rng").agg(F.max("sq").alias("top"))
    reach = F.sqrt("sq") * F.sqrt("top") * (1 + ROUNDING) + 1e-6
    wanted = (queries.join(least, ["dim", "pos"], "left").join(ranges, "dim")
              .filter(F.col("least").isNull() | (reach >= F.col("least") - F.abs("least") * 1e-12)))
    copies = wanted.select("dim", "rng", "qb").distinct()
    others = rows.filter("rng > 0").join(copies, ["dim", "rng"]).select("dim", "rng", "qb", "id", "x")
    found = first.unionByName(_searched(others, wanted, k))

    place = Window.partitionBy("dim", "qpos").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
