"""Document fingerprints from closed syncmers.

A text's units are its words (``[^\\x20\\x09-\\x0D]+``).  Of the runs of ``K``
words, those are chosen as anchors whose smallest inner run of ``S`` words
stands at either edge.  The choice looks at the run alone, never at its
surroundings, so an edit changes only the anchors that it touches.  A text of
fewer than ``K`` words has one anchor, the whole sequence; a longer one
without a chosen run has the run of the smallest hash.

From ``4 * (2 * K - S - 1)`` words on, a quarter of them holds an anchor for
sure.  Shorter texts have anchors of code points besides, chosen by the same
rule from runs of ``CODE_K`` code points of the words with one space between.

The fingerprint is the list ``place:hash`` of the anchors in order (hex, the
place as the distance from the anchor before; anchors of words first, those of
code points, places too, have a hash of nine digits).  Two fingerprints'
likeness matches anchors by hash within each hash's order of occurrence and
takes the matched pairs whose shift in place lies near the commonest shift, as
a share of the larger number of anchors.  It looks at code points if both texts
are short, else at words.

Nulls are empty texts.  The fingerprint of a text without words is empty; two
of these are alike (1.0), one of these and another are not (0.0).  Repeated
rows each get a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, rolling, sliding_min, word_hashes, words

K, S = 16, 4
CODE_K, CODE_S = 4, 2
CODE = np.uint64(1 << 32)   # marks the hashes of code points
DRIFT = 8   # words that the shift of a match may differ from the commonest one


def _chosen(h: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and 32-bit hashes of the closed syncmers of a sequence; at least one."""
    n = len(h)
    if n < k:
        return np.zeros(1, np.int64), mix(rolling(h, n) + np.uint64(n)) >> np.uint64(32)
    inner, runs = rolling(h, s), rolling(h, k)
    least = sliding_min(inner, k - s + 1)
    m = n - k + 1
    at = np.flatnonzero((inner[:m] == least) | (inner[k - s:k - s + m] == least))
    if not len(at):
        at = np.array([runs.argmin()])
    return at, runs[at] >> np.uint64(32)


def anchors(text: str | None, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places (word index) and hashes of the anchors of words, then places
    (code point) and hashes of those of code points, which a short text has."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, hashes = _chosen(word_hashes(ws), k, s)
    if len(ws) >= 4 * (2 * k - s - 1):
        return at, hashes
    points = b" ".join(ws).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
    places, codes = _chosen(mix(np.frombuffer(points, "<u4").astype(np.uint64) + np.uint64(1)), CODE_K, CODE_S)
    return np.concatenate([at, places]), np.concatenate([hashes, codes | CODE])


def as_text(at: np.ndarray, hashes: np.ndarray) -> str:
    gaps = np.diff(at, prepend=0)
    return " ".join([f"{g:x}:{h:08x}" for g, h in zip(gaps.tolist(), hashes.tolist())])


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = [p.split(":") for p in fingerprint.split()]
    return (np.cumsum([int(g, 16) for g, _ in pairs], dtype=np.int64),
            np.array([int(h, 16) for _, h in pairs], np.uint64))


def _ordered(hashes: np.ndarray):
    """Hashes made distinct by their order of occurrence, sorted, with the
    index of each."""
    by = np.argsort(hashes, kind="stable")
    v = hashes[by]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    return (v << np.uint64(32)) | (np.arange(len(v)) - start).astype(np.uint64), by


def likeness(a, b) -> float:
    """0 to 1: share of anchors that match in hash and in place."""
    (pa_, ha), (pb, hb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    if ha[-1] >= CODE or hb[-1] >= CODE:
        short = ha[-1] >= CODE and hb[-1] >= CODE
        (pa_, ha), (pb, hb) = ((p[(h >= CODE) == short], h[(h >= CODE) == short]) for p, h in (a, b))
    ka, ia = _ordered(ha)
    kb, ib = _ordered(hb)
    _, x, y = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(x):
        return 0.0
    shift = np.sort(pb[ib[y]] - pa_[ia[x]])
    near = np.searchsorted(shift, shift + DRIFT, side="right") - np.searchsorted(shift, shift - DRIFT, side="left")
    return float(near.max()) / max(len(ha), len(hb))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the
    next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint_pairs(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, s: int = S) -> DataFrame:
    """Fingerprint of every text, of its edited text, and both likenesses.

    Texts meet the next one in the order of ``key`` (null first; equal keys
    by text) without a global sort: keys are cut at quantiles into ranges,
    ranges are shuffled once and sorted within, and the first row of the next
    range that has rows is sent along as the range's tail."""
    spark = docs.sparkSession
    n = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    base = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("k", F.coalesce(F.col(key), F.lit(-(1 << 63))))
    if base.agg(F.min("k")).first()[0] is None:
        return base.select(key).limit(0).selectExpr(
            key, "0L n_chars", "'' edited_sha256", "'' fingerprint", "'' edited_fingerprint", "0D near_edited", "0D near_next")
    # number of quantiles up to the key; the list is bounded by the partitions
    cuts = sorted(set(base.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n)).first()[0]))
    bucket = F.aggregate(F.array(*[F.lit(c).cast("long") for c in cuts]), F.lit(0),
                         lambda m, c: m + F.when(c <= F.col("k"), 1).otherwise(0))
    ranged = base.withColumn("bucket", bucket)
    heads = sorted((r.bucket, r.k) for r in ranged.groupBy("bucket").agg(F.min("k").alias("k")).collect())
    # the head of each range ends the range before it; the first ends the last
    tails = spark.createDataFrame([(heads[(i + 1) % len(heads)][1], b) for i, (b, _) in enumerate(heads)], "k long, ends int")
    ends = ranged.join(F.broadcast(tails), "k").select(key, "text", "k", F.col("ends").alias("bucket"), F.lit(1).alias("tail"))
    dealt = (ranged.select(key, "text", "k", "bucket", F.lit(0).alias("tail")).union(ends)
             .repartition(n // 4, "bucket").sortWithinPartitions("bucket", "tail", "k", "text"))

    def run(batches):
        held = None          # the row that waits for the next one

        def row(now, following, marks):
            changed = edited(now[1], following)
            e = anchors(changed, k, s)
            return (now[0], len(now[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                    as_text(*now[2]), as_text(*e), likeness(now[2], e), likeness(now[2], marks))

        for b in batches:
            out = []
            for i, t, bucket, tail in zip(*(b.column(c).to_pylist() for c in (key, "text", "bucket", "tail"))):
                marks = anchors(t, k, s)
                if held is not None and held[3] == bucket:
                    out.append(row(held, t, marks))
                held = None if tail else (i, t, marks, bucket)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in out], kind) for j, kind in enumerate(
                    (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))],
                names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
