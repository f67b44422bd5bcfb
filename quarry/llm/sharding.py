"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records uniformly into buckets small enough for a
task's memory, by a seeded hash.  A bucket is one partition, whatever its
number (``repartitionById``), so no two buckets meet in a task.  Pass two
permutes each bucket with a seeded Fisher-Yates shuffle (``shuffle``) and
writes it.  A running sum of the bucket counts gives each record its place in
the whole order; places are dealt round the shards, so shard counts differ by
one at most (law ``rows``) whatever the keys, sources or copies are, and slots
have no gaps.

Rows that are equal in every column are counted and get ordinals, which belong
to the hash: a repeated row spreads over all buckets as other rows do.  Null
texts have no bytes; ties in the order of a bucket are equal rows, whose order
does not show; an empty table gives empty shards.  The number of buckets
depends on the bytes of the table, the bucket of a record on the record, its
ordinal and the parameters, and a permutation on the seed, the bucket's number
and its records: results do not depend on how the input or a shuffle is
partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 16
BROADCAST_BUCKETS = 1 << 20
BROADCAST_REPEATED = 1 << 20     # hashes of repeated rows, a long each
SEED = 42


def text_size(text: str = "text"):
    """UTF-8 bytes (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def with_ordinals(docs: DataFrame) -> DataFrame:
    """``(rec, ordinal)``: every row as a struct, and the equal rows numbered
    from 0.  Only rows whose hash occurs again are grouped, with their counts
    added up map-side; the others pass as they are."""
    rec = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(rec.alias("rec"), F.xxhash64(rec).alias("h"))
    again = rows.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h")
    if again.isEmpty():
        return rows.select("rec", F.lit(0).cast("long").alias("ordinal"))
    if again.count() <= BROADCAST_REPEATED:
        again = F.broadcast(again)
    repeated = (rows.join(again, "h", "left_semi").groupBy("rec").agg(F.count(F.lit(1)).alias("m"))
                .select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("ordinal")))
    return rows.join(again, "h", "left_anti").select("rec", F.lit(0).cast("long").alias("ordinal")).unionByName(repeated)


def scatter(docs: DataFrame, size, order: str, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Pass one: ``(bucket, rec)``; buckets hold about ``bucket_bytes`` each,
    and bucket ``b`` is partition ``b``."""
    total = docs.agg(F.sum(size)).first()[0] or 0
    n = max(LEAST_BUCKETS, math.ceil(total / bucket_bytes))
    rows = with_ordinals(docs.select(F.col(order), *[c for c in docs.columns if c != order]))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "rec", "ordinal"), F.lit(n)).cast("int")
    return rows.select(bucket.alias("bucket"), "rec").repartitionById(n, "bucket")


def shuffled(docs: DataFrame, size, order: str, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Pass two: ``(bucket, at, rec)`` with a record's place in its bucket.
    Buckets are sorted first, so the permutation depends on the seed alone."""
    boxes = (scatter(docs, size, order, bucket_bytes, seed).groupBy("bucket")
             .agg(F.sort_array(F.collect_list("rec")).alias("recs")).sortWithinPartitions("bucket"))
    return boxes.select("bucket", F.posexplode(F.shuffle("recs", seed)).alias("at", "rec"))


def write_shards(docs: DataFrame, path: str, shards: int, order: str = "doc_id", text: str = "text",
                 bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Writes the shuffled buckets below ``path`` and returns the shards: the
    columns of ``docs`` (but those of the same names), ``shard`` and ``slot``."""
    docs = docs.drop("shard", "slot")
    shuffled(docs, text_size(text), order, bucket_bytes, seed).write.parquet(path)
    boxes = docs.sparkSession.read.parquet(path)
    counts = boxes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # one row a bucket: bounded by the input over the size of a bucket
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    if counts.count() <= BROADCAST_BUCKETS:      # two longs a row; else the join shuffles
        starts = F.broadcast(starts)
    place = (F.col("start") + F.col("at")).cast("long")
    return (boxes.join(starts, "bucket")
            .select("rec.*", F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
                    F.floor(place / shards).cast("long").alias("slot")))
