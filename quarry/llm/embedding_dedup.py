"""Embedding near-duplicates by iterative quantisation.

1. Equal vectors form one class.
2. A bounded sample of the classes fits the rotations: centre, principal
   axes, then alternately signs and the orthogonal matrix that brings the data
   nearest to them (iterative quantisation).  Every vector gets one binary
   code per rotation.
3. Multi-index tables: each code is cut into substrings, and vectors that
   share a substring are candidates.  How often a bit differs between two
   vectors at the threshold depends on the data (a common mean makes centred
   vectors differ more), so it is measured: for sampled vectors, partners at
   exactly the threshold are made in random directions and in those of other
   vectors.  The length of the substrings is the cheapest for the number of
   classes, and rotations are added until the tables find ``RECALL`` of the
   made pairs of both kinds.  If they do not, substrings are halved, at last
   to single bits.
4. Candidates whose first two codes differ in more bits than those of nearly
   all made pairs (``FAR_KEEPS``) go at once.
5. The rest is ranked by the cosine of the original vectors in double
   precision; pairs that reach the threshold are links.

Vectors of different dimensions never link; every dimension has rotations and
tables of its own, in the same jobs.  A vector that is null, empty, zero, or
holds a null or non-finite component links with nothing.  Copies count as
links of each other, but their pairs are never written out.  Repeated rows
are copies; vectors at equal distance need no order, as every pair at the
threshold is a link; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

COSINE = 0.95
SAMPLE = 8192       # bound of the sample that fits the rotations
ROUNDS = 40
MAX_BITS = 64       # of one code
RECALL = 0.96       # share of the made pairs that the tables must find
FAR_KEEPS = 0.998   # share of the made pairs within the limit of differing bits
MADE = 2048         # made pairs of a kind
ROW_COST = 20       # of a row in a table, in comparisons of two codes
GROUP = 16          # tables joined at a time, which bounds the shuffle files


@dataclass
class Plan:
    """Table ``t`` holds substring ``t % per`` of the code by rotation
    ``t // per``; a code's bits are the signs of (x - mean) @ axes @ rotation."""
    mean: np.ndarray
    axes: np.ndarray
    rotations: list
    sub: int            # bits of a substring
    tables: int
    far: int            # of the bits of the first two codes
    recall: float       # of the made pairs

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        v = (x - self.mean) @ self.axes
        weight = np.uint64(1) << np.arange(v.shape[1], dtype=np.uint64)
        return [((v @ r >= 0) * weight).sum(axis=1, dtype=np.uint64) for r in self.rotations]

    def cells(self, codes: list[np.ndarray]) -> np.ndarray:
        """A column a table."""
        per, mask = self.axes.shape[1] // self.sub, np.uint64((1 << self.sub) - 1)
        return np.stack([(codes[t // per] >> np.uint64(t % per * self.sub)) & mask for t in range(self.tables)],
                        axis=1).astype(np.int64)


def learn_rotation(v: np.ndarray, rng, rounds: int = ROUNDS) -> np.ndarray:
    r, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
    for _ in range(rounds):
        u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ wt).T
    return r


def made_pairs(sample: np.ndarray, cosine: float, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sampled vectors with a partner at the threshold, in a random direction
    and in the direction of another vector."""
    out = []
    for random in (True, False):
        x = sample[rng.permutation(len(sample))[:MADE]]
        u = rng.standard_normal(x.shape) if random else sample[rng.permutation(len(sample))[:len(x)]]
        u = u - (u * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(u, axis=1, keepdims=True)
        ok = size[:, 0] > 1e-6
        out.append((x[ok], cosine * x[ok] + np.sqrt(1 - cosine ** 2) * u[ok] / size[ok]))
    return [pair for pair in out if len(pair[0])]


def fit(sample: np.ndarray, n: int, cosine: float = COSINE, sub: int | None = None, seed: int = 7) -> Plan:
    """The plan for ``n`` classes from unit vectors of some of them; ``sub``
    sets the length of the substrings to begin with."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    x = sample - mean
    bits = min(MAX_BITS, x.shape[1])
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :bits]     # by falling variance
    v = x @ axes
    made = [[(p - mean) @ axes for p in pair] for pair in made_pairs(sample, cosine, rng)]
    rotations, differ = [], [[] for _ in made]

    def add():
        rotations.append(r := learn_rotation(v, rng))
        for (a, b), known in zip(made, differ):
            known.append((a @ r >= 0) != (b @ r >= 0))

    def hits(d, length):
        """Which pairs share which substrings of one code."""
        per = bits // length
        return ~d[:, :per * length].reshape(len(d), per, length).any(axis=2)

    add()
    add()
    apart = [np.concatenate(known, axis=1).sum(axis=1) for known in differ]
    far = max((int(np.quantile(d, FAR_KEEPS, method="higher")) for d in apart), default=2 * bits)
    signs = [v @ r >= 0 for r in rotations]

    def cost(length):
        """Rows and comparisons, and the tables that they are for, if tables
        were independent."""
        share = min((np.mean([hits(d, length).mean() for d in known]) for known in differ), default=1.0)
        if not share:
            return math.inf, 0
        tables = 1 if share >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - share))
        weight = 1 << np.arange(length, dtype=np.int64)
        many = [np.unique(s[:, :length] @ weight, return_counts=True)[1] for s in signs]
        meet = max(0.5 ** length, float(np.mean([(c * (c - 1.0)).sum() for c in many])) / max(1, len(v) * (len(v) - 1)))
        return tables * (n * ROW_COST + n * n / 2 * meet), tables

    if sub is None:
        sub = min(range(1, min(bits, 40) + 1), key=lambda length: cost(length)[0])
    sub = min(sub, bits)
    while True:
        most = 4 * cost(sub)[1]
        while True:
            found = [np.logical_or.accumulate(np.concatenate([hits(d, sub) for d in known], axis=1), axis=1)
                     & (d0 <= far)[:, None] for known, d0 in zip(differ, apart)]
            recall = np.min([f.mean(axis=0) for f in found], axis=0) if found else np.ones(2 * (bits // sub))
            enough = np.flatnonzero(recall >= RECALL)
            if len(enough):
                return Plan(mean, axes, rotations, sub, int(enough[0]) + 1, far, float(recall[enough[0]]))
            if len(recall) >= most and sub > 1:
                break
            add()
        sub //= 2


def _by_dimension(column: pa.Array):
    """``(dimension, row numbers, unit vectors)`` of the rows of a batch."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    start = np.cumsum(size) - size
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        x = values[start[at][:, None] + np.arange(dim)]
        yield dim, at, x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit_dimensions(classes: DataFrame, cosine: float, sub: int | None) -> dict[int, Plan]:
    """A plan for each dimension that more than one class has."""
    plans = {}
    for dim, n in sorted(map(tuple, classes.groupBy("dim").count().collect())):
        if n > 1:
            # the sample's order is that of the hashes: any bounded number of rows will do
            sample = classes.filter(F.col("dim") == dim).orderBy("cid").limit(SAMPLE).select("v").toArrow()
            plans[dim] = fit(next(_by_dimension(sample.column(0).combine_chunks()))[2], n, cosine, sub)
    return plans


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE,
                 sub: int | None = None) -> DataFrame:
    """``(key, n_links, component_id, kept)`` of every row; ``sub`` as for ``fit``."""
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    size = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    sound = (v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
             & (size > 0) & (size < float("inf")))
    rows = (rows.withColumn("dim", F.when(sound, F.size(v)))
            .withColumn("cid", F.when(F.col("dim").isNotNull(), F.xxhash64("dim", "v"))))
    classes = cut(rows.filter("cid is not null").groupBy("cid", "dim")
                  .agg(F.first("v").alias("v"), F.min("id").alias("first"), F.count(F.lit(1)).alias("many")))
    plans = _fit_dimensions(classes, cosine, sub)

    if plans:
        # plain arrays travel: a class of this module would need the module on the executors
        learned = spark.sparkContext.broadcast({dim: tuple(vars(p).values()) for dim, p in plans.items()})
        tables = max(p.tables for p in plans.values())

        def code(batches):
            plans = {dim: Plan(*p) for dim, p in learned.value.items()}
            for b in batches:
                for dim, at, x in _by_dimension(b.column(1)):
                    if dim not in plans:
                        continue
                    codes = plans[dim].codes(x)
                    cells = plans[dim].cells(codes)
                    ends = np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim), pa.int32()),
                         pa.array(np.full(len(at), plans[dim].far), pa.int32()),
                         *[pa.array(c.view(np.int64)) for c in codes[:2]],
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(cells.ravel()))],
                        names=["cid", "dim", "far", "c0", "c1", "cells"])

        codes = cut(classes.select("cid", "v").mapInArrow(
            code, "cid long, dim int, far int, c0 long, c1 long, cells array<long>"))
        found = []
        for first in range(0, tables, GROUP):
            index = codes.select("cid", "dim", "far", "c0", "c1", F.posexplode(F.slice("cells", first + 1, GROUP)).alias("t", "s"))
            found.append(cut(index.alias("x").join(index.alias("y"), F.expr(
                "x.dim = y.dim and x.t = y.t and x.s = y.s and x.cid < y.cid and "
                "bit_count(x.c0 ^ y.c0) + bit_count(x.c1 ^ y.c1) <= x.far"))
                .select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()))
        pairs = found[0] if len(found) == 1 else cut(reduce(DataFrame.union, found).distinct())
        both = (pairs.join(classes.select(F.col("cid").alias("a"), F.col("v").alias("va")), "a")
                .join(classes.select(F.col("cid").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", "va", "vb"))

        def rank(batches):
            for b in batches:
                near = np.zeros(b.num_rows, bool)
                for (_, at, x), (_, _, y) in zip(_by_dimension(b.column(2)), _by_dimension(b.column(3))):
                    near[at] = (x * y).sum(axis=1) >= cosine
                if near.any():
                    yield pa.record_batch({"a": b.column(0), "b": b.column(1)}).filter(pa.array(near))

        links = cut(both.mapInArrow(rank, "a long, b long"))
    else:
        links = spark.createDataFrame([], "a long, b long")

    label = components(links)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = (both.join(classes.select(F.col("cid").alias("b"), "many"), "b")
              .groupBy(F.col("a").alias("cid")).agg(F.sum("many").alias("others")))
    known = (classes.select("cid", "first", "many").join(others, "cid", "left")
             .join(label.withColumnRenamed("node", "cid"), "cid", "left")
             .select("cid", "first", (F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                     F.coalesce("label", "cid").alias("label")))
    least = known.groupBy("label").agg(F.min("first").alias("component_id"))
    known = known.join(least, "label").select("cid", "n_links", "component_id")
    return (rows.select("id", "cid").join(known, "cid", "left")
            .select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False))))
