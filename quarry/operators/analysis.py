"""D3, D5-D8, G3/G4 usage: length analysis of a corpus.

All of these are single-pass aggregates with partial aggregation: bins come
from a table of distinct values and their counts.  The histogram and cumulative
tables have at most ``bins`` rows, so the global window in D8 runs over a
bounded input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.text import char_length, count_tokens, count_words
from quarry.operators.util import stored


def with_lengths(docs: DataFrame, text: str = "text", tokenizer=None) -> DataFrame:
    """Add ``n_words`` (G3) and ``n_tokens`` (G4) to a corpus."""
    return docs.withColumn("n_words", count_words(F.col(text))) \
               .withColumn("n_tokens", count_tokens(F.col(text), tokenizer))


def max_lengths(docs: DataFrame, docno: str = "docno", text: str = "text") -> DataFrame:
    """D3: longest id and longest text, in characters."""
    return docs.agg(F.max(char_length(F.col(docno).cast("string"))).alias("max_docno_len"),
                    F.max(char_length(F.col(text))).alias("max_text_len"))


def describe(df: DataFrame, col: str) -> DataFrame:
    """Pandas ``describe()``: count, mean, std (sample), min, quartiles
    (linear interpolation), max.  ``percentile`` is exact; it keeps a
    value->count map, which stays small for integer lengths."""
    x = F.col(col)
    q = F.percentile(x.cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"),
                   F.stddev_samp(x).alias("std"), F.min(x).cast("double").alias("min"),
                   q.alias("q"), F.max(x).cast("double").alias("max"))
            .select("count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min")],
                    *[F.round(F.get("q", i), 6).alias(n) for i, n in enumerate(("p25", "p50", "p75"))],
                    F.round("max", 6).alias("max")))


def fraction_within(df: DataFrame, col: str, limit: int = 512) -> DataFrame:
    """B7 + D6: share of rows with ``col <= limit``."""
    return df.agg(F.round(F.avg((F.col(col) <= limit).cast("double")), 6).alias("fraction"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """``(value, count)`` of the values that are not null: one mergeable
    aggregate, written once.  Bins, shares and ranges follow from it without
    another look at the rows."""
    return stored(df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("value"))
                  .agg(F.count(F.lit(1)).alias("count")), "values")


def _binned(df: DataFrame, col: str, bins: int) -> DataFrame:
    values = value_counts(df, col)
    mn, mx = values.agg(F.min("value"), F.max("value")).first()      # two numbers
    lo, width = F.lit(mn).cast("double"), (mx - mn if mn is not None else None)
    x = F.col("value")
    b = F.least(F.floor((x - lo) * float(bins) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
    counts = values.groupBy(b.cast("int").alias("bin")).agg(F.sum("count").alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda i: F.round(lo + i * F.lit(width).cast("double") / float(bins), 6)       # noqa: E731
    return (grid.join(F.broadcast(counts), "bin", "left")       # at most one row a bin
            .select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"),
                    F.coalesce("count", F.lit(0)).alias("count")))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max]; the maximum falls in the
    last bin.  Always ``bins`` rows ``(bin, lo, hi, count)``."""
    return _binned(df, col, bins)


def cumulative(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Cumulative percentage per bin, each row weighted ``100 / N``."""
    h = _binned(df, col, bins)
    w = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)  # <= bins rows
    total = F.sum("count").over(W.partitionBy(F.lit(1)))
    return h.select("bin", "lo", "hi",
                    F.round(F.sum("count").over(w) * 100.0 / total, 6).alias("cum_pct"))
