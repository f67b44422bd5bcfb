"""Mixing sources to target weights by systematic sampling, in DataFrame
functions only.

Sources get targets in words from their weights; a target stops at
``max_copies`` times its source's size and the excess is shared anew by
weight.  Every document of a source expects ``target / size`` copies.  Within
the source, in an order that follows document size, the expected copies are
summed up; one random offset per source is added, and a document is emitted
once for each integer boundary that its stretch of the sum crosses.  As the
order follows size, the words taken come near the target as well.

The order is (size class, hash bucket, size, hash, id), rising for one half
of the documents and then falling for the other, so that both ends of the sum
are small documents.  Documents are counted by class and bucket, the counts
give each bucket its start, and ranks are local to buckets.  So a source with a third of all rows is many small groups.

The hash is MD5, which SQL engines share; reruns agree.  A null text has size
0; a source without words has target 0; the null source is a source of its
own and comes last; repeated rows are documents of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKETS = 64
TOP = 256    # above any size class
SEED = "mix-1"


def n_words(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    t = F.coalesce(F.col(text), F.lit(""))
    # an empty first or last part is not a word
    trimmed = F.trim(t, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def hash_unit(*parts: Column) -> Column:
    """0 <= x < 1 from the first 13 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``(source, source_size)`` to targets: one row a source."""
    # one row a source; the windows below see sources, not documents
    order = Window.orderBy(F.col("source").asc())
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                                (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)))
    w = w.withColumn("cap", F.col("source_size").cast("double") * max_copies)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source that the level doesn't fill gives the level of all later ones
    w = w.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    w = w.withColumn("final", F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("o"), "level"))).over(every))
    return w.select("source", "source_size", F.least("cap", F.col("final.level") * F.col("weight")).alias("target"))


def copies(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights: tuple = WEIGHTS,
           max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """``(doc, size, source_size, target, copies)``; ``doc`` holds the columns
    of ``docs``, so none of their names can clash."""
    d = docs.select(F.struct("*").alias("doc"), size.alias("size"),
                    # never null; sorts as the sources do by code point, the null one last
                    F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("t")).alias("s"),
                    F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"))
    d = d.withColumn("u", hash_unit(F.lit(seed), F.col("k")))
    level = F.when(F.col("size") == 0, 0).otherwise(F.floor(F.log2(F.col("size").cast("double")) * 4).cast("int") + 1)
    rises = F.col("u") < 0.5
    d = (d.withColumn("class", F.when(rises, level).otherwise(2 * TOP - level))
         .withColumn("bucket", F.floor(F.col("u") * BUCKETS).cast("int")))
    boxes = d.groupBy("s", "class", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    goal = targets(boxes.groupBy(F.col("s").alias("source")).agg(F.sum("words").alias("source_size")), weights, max_copies)
    before = Window.partitionBy("s").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = boxes.select("s", "class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = starts.join(goal.withColumnRenamed("source", "s"), "s")
    own = Window.partitionBy("s", "class", "bucket").orderBy(
        F.when(rises, F.col("size")).otherwise(-F.col("size")), "u", "k")
    joined = d.withColumn("at", F.row_number().over(own)).join(starts, ["s", "class", "bucket"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = hash_unit(F.lit(seed), F.lit("offset"), F.col("s"))
    rank = (F.col("start") + F.col("at")).cast("double")
    taken = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    return joined.select("doc", "size", "source_size", "target", taken.cast("long").alias("copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple = WEIGHTS,
        max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The mixture: each document as often as it was drawn, its columns only."""
    drawn = copies(docs, n_words(text), source, key, weights, max_copies, seed).filter("copies > 0")
    return drawn.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
