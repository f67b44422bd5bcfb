"""Building the collection, topics and judgments.

The reference concatenates three splits (train, validation, test), keeps
the first record of every ``para_id`` and writes the result; topics are
cleaned, sorted by id and cut to the first 10,000; judgments are one row
per test record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import clean_question
from quarry.sources.json_io import COLLECTION_FIELDS

SEED = 42
FIRST_TOPICS = 10_000
SAMPLE_SIZE = 1_000


def project(records: DataFrame, fields=COLLECTION_FIELDS) -> DataFrame:
    """B2: the collection fields, ``""`` for missing (and null) values."""
    keep = [c for c in records.columns if c in ("src_ord", "pos")]
    return records.select(*keep, *[
        (F.coalesce(F.col(f).cast("string"), F.lit("")) if f in records.columns else F.lit(""))
        .alias(f) for f in fields])


def union_splits(*splits: DataFrame) -> DataFrame:
    """concatenate splits in order, duplicates kept; ``src_ord`` records
    which split a row came from (``pos`` is its position inside it)."""
    out = None
    for i, s in enumerate(splits):
        s = s.withColumn("src_ord", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def non_empty_id(df: DataFrame, col: str = "para_id") -> DataFrame:
    """Drop rows whose id is null or empty."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) != ""))


def dedup_keep_first(records: DataFrame, key: str = "para_id",
                     order=("src_ord", "pos")) -> DataFrame:
    """One row per non-empty ``key`` - the first in (split, position)
    order.  One partially aggregated shuffle by key (``min_by`` on the
    order struct), so a hot key costs one row per task before the shuffle.
    The result carries the order columns; sort by them for first-seen order.
    """
    order_s = F.struct(*[F.col(c) for c in order])
    other = [c for c in records.columns if c != key]
    rec = F.struct(*[F.col(c) for c in other])
    return (non_empty_id(records, key)
            .groupBy(key).agg(F.min_by(rec, order_s).alias("r"))
            .select(key, "r.*"))


def topic_order(id_col: str = "query_id") -> list[Column]:
    """Numeric order for digit-only ids, then the others as strings."""
    c = F.col(id_col).cast("string")
    numeric = F.when(c.rlike(r"^[0-9]+$"), c.cast("decimal(38,0)"))
    return [numeric.asc_nulls_last(), c.asc()]


def build_topics(test_records: DataFrame, first_n: int | None = FIRST_TOPICS,
                 normalize: bool = True) -> DataFrame:
    """G1 + E3 + E4: ``(query_id, question)`` cleaned, sorted, first ``first_n``."""
    t = test_records.select(
        F.coalesce(F.col("query_id").cast("string"), F.lit("")).alias("query_id"),
        clean_question(F.col("question"), normalize=normalize).alias("question"))
    t = t.orderBy(*topic_order("query_id"))
    return t.limit(first_n) if first_n is not None else t


def sample_topics(topics: DataFrame, n: int = SAMPLE_SIZE, seed: int = SEED,
                  qid: str = "qid") -> DataFrame:
    """E5: ``min(n, count)`` topics without replacement, reproducible for a
    seed: order by a seeded hash of the id (ties by id) and keep ``n``."""
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(qid).cast("string")))
    return topics.orderBy(key, F.col(qid)).limit(n)


def build_qrels(test_records: DataFrame) -> DataFrame:
    """``(query_id, iteration=0, para_id, relevance=1)`` for every test row."""
    return test_records.select(
        F.coalesce(F.col("query_id").cast("string"), F.lit("")).alias("query_id"),
        F.lit(0).alias("iteration"),
        F.coalesce(F.col("para_id").cast("string"), F.lit("")).alias("para_id"),
        F.lit(1).alias("relevance"))


def build_answers(test_records: DataFrame) -> DataFrame:
    """Judgments plus ``answer`` and ``org_answer``."""
    return test_records.select(
        F.coalesce(F.col("query_id").cast("string"), F.lit("")).alias("query_id"),
        F.lit(0).alias("iteration"),
        F.coalesce(F.col("para_id").cast("string"), F.lit("")).alias("para_id"),
        F.lit(1).alias("relevance"),
        F.coalesce(F.col("answer").cast("string"), F.lit("")).alias("answer"),
        F.coalesce(F.col("org_answer").cast("string"), F.lit("")).alias("org_answer"))


def keep_original_query(topics: DataFrame) -> DataFrame:
    """``query_0`` holds the query before it is rewritten."""
    return topics.withColumn("query_0", F.col("query"))


def summary(df: DataFrame, order_by: str, top_n: int = 5) -> DataFrame:
    """The first ``top_n`` rows by ``order_by`` with the total row count."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(order_by).limit(top_n).withColumn("n_rows", n)
