"""Small shared helpers: size-checked broadcast, ranking, rounding."""

from __future__ import annotations

import math
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quarry.session import temporary_path

# Largest size we broadcast, in bytes of column values.  Every broadcast in the
# package goes through ``broadcast_if_small`` so the bound is checked at run
# time; above it the planner's shuffle join is used instead.
BROADCAST_MAX_BYTES = 64 << 20

# Scores are rounded before ranking so that ties and order do not depend on
# the summation order of a shuffle.
SCORE_DECIMALS = 6

# Partitions from which on a top-k merges its partial limits in two levels.
MERGE_PARTS = 64


_COUNTS: "weakref.WeakKeyDictionary" = weakref.WeakKeyDictionary()


def _memo(df: DataFrame) -> dict:
    try:
        return _COUNTS.setdefault(df, {})
    except TypeError:  # not weak-referenceable
        return {}


def _value_bytes(field: T.StructField) -> Column:
    """Bytes of one column's value: 8 for a fixed one, content plus 8 otherwise."""
    c, t = F.col(f"`{field.name}`"), field.dataType
    if isinstance(t, (T.StringType, T.BinaryType)):
        n = F.octet_length(c) + 8
    elif isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.NumericType, T.BooleanType)):
        n = F.size(c) * 8 + 8
    elif isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        n = F.octet_length(F.to_json(F.struct(c))) + 8
    else:
        n = F.lit(8)
    return F.coalesce(n.cast("long"), F.lit(8))


def known_size(df: DataFrame) -> tuple[int, int]:
    """``(rows, bytes of all column values)``, measured by one aggregate and
    remembered per DataFrame object: DataFrames are immutable, so repeated
    size checks on the same query table run once."""
    memo = _memo(df)
    if "size" not in memo:
        width = sum((_value_bytes(f) for f in df.schema.fields), F.lit(0).cast("long"))
        r = df.select(width.alias("w")).agg(F.count(F.lit(1)), F.sum("w")).first()
        memo["size"] = (int(r[0]), int(r[1] or 0))
    return memo["size"]


def known_values(df: DataFrame, name: str, value: Column) -> list:
    """Distinct values (not null) of an expression over ``df``, remembered like
    ``known_size`` under ``name``; for few values only."""
    memo = _memo(df)
    if name not in memo:
        memo[name] = sorted(r[0] for r in df.select(value.alias("v")).filter("v is not null").distinct().collect())
    return memo[name]


def content_key(df: DataFrame) -> str:
    """Key of a frame's rows whatever their order (one aggregate): equal rows
    give an equal key, other rows another one."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    r = df.select(h.alias("h")).agg(
        F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return "|".join([",".join(sorted(df.columns)), *map(str, r)])


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES,
                       size: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its bytes are proven <= ``max_bytes``.

    ``size`` may carry an already known upper bound in bytes; otherwise the
    frame is measured (one job).
    """
    n = known_size(df)[1] if size is None else size
    return F.broadcast(df) if n <= max_bytes else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there, for
    tables of a few rows a query that several steps read.  Such a table is not
    written again.  Its files go when the process ends."""
    if _memo(df).get("stored"):
        return df
    spark = df.sparkSession
    path = temporary_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _memo(out)["stored"] = True
    return out


def read_back(df: DataFrame) -> DataFrame:
    """``df``, columns of a ``stored`` table, which need not be written again."""
    _memo(df)["stored"] = True
    return df


def run_starts(array: str, field: str | None = None) -> Column:
    """Indexes at which a run of equal values begins in a sorted array column
    (of the values' ``field``).  Elements are read in place, so this is linear."""
    at = lambda i: F.get(array, i) if field is None else F.get(array, i)[field]            # noqa: E731
    return F.when(F.size(array) > 0, F.filter(
        F.sequence(F.lit(0), F.size(array) - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    ).otherwise(F.array().cast("array<int>"))


def run_end(array: str, starts: str, j: Column) -> Column:
    """Index after the ``j``-th of the runs that ``run_starts`` gave as ``starts``."""
    return F.coalesce(F.get(starts, j + 1), F.size(array))


def round_score(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), SCORE_DECIMALS)


def round_scores(x: np.ndarray) -> np.ndarray:
    """``round_score`` for an array."""
    return np.copysign(np.floor(np.abs(x) * 10 ** SCORE_DECIMALS + 0.5) / 10 ** SCORE_DECIMALS, x) + 0.0


def one_array(column) -> pa.Array:
    """A column in one chunk."""
    if not isinstance(column, pa.ChunkedArray):
        return column
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs ``start .. start + count``: each element's run, and the element."""
    run = np.repeat(np.arange(len(count)), count)
    return run, np.arange(len(run)) - (np.cumsum(count) - count)[run] + start[run]


def rank_window(group: str | list[str] = "qid", score: str = "score",
                tie: str = "docno"):
    group = [group] if isinstance(group, str) else list(group)
    return W.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie).asc())


def top_k(df: DataFrame, k: int | None, group: str | list[str] = "qid",
          score: str = "score", tie: str = "docno",
          rank_col: str = "rank", parts: int = 1) -> DataFrame:
    """E1+E2: ``row_number`` per group by score desc, tie by ``tie`` asc.

    The ``rank <= k`` filter lets Spark plan a partial ``WindowGroupLimit``
    before the shuffle, so at most partitions x groups x k rows move.

    ``parts`` tells in how many partitions a group's rows may lie.  Beyond
    ``MERGE_PARTS`` the limits merge in two levels: first by group and slice
    (a hash of ``tie``; about the root of ``parts`` slices), so no task gets more
    than slices x k rows of one group.
    """
    if k is not None and parts > MERGE_PARTS:
        group_cols = [group] if isinstance(group, str) else list(group)
        df = (df.withColumn("__slice", F.pmod(F.xxhash64(tie), F.lit(math.isqrt(parts))))
              .withColumn("__at", F.row_number().over(rank_window([*group_cols, "__slice"], score, tie)))
              .filter(F.col("__at") <= k).drop("__slice", "__at"))
    ranked = df.withColumn(rank_col, F.row_number().over(rank_window(group, score, tie)))
    if k is not None:
        ranked = ranked.filter(F.col(rank_col) <= k)
    return ranked
