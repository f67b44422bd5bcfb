"""Helpers shared by the training-data operators.

* ``words`` rule: bytes split on ASCII white space, i.e. the regular
  expression ``[^\\x20\\x09-\\x0D]+`` on the text.
* ``word_hashes`` / ``rolling``: 64-bit hashes of words and of runs of words.
* ``cut``: cut lineage with a table written to the shared folder.
* ``numbered``: places of rows in their groups without one task a group.
* ``components``: connected components of an edge table.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import scratch_path

#: Bytes of words and their hashes that a worker remembers before it starts anew.
CACHE_BYTES = 24 << 20
ENTRY_BYTES = 130       # of an entry beside its word
LONG_WORD = 64          # bytes from which on a word is hashed anew each time
#: Spark removes the shuffle files of a query when it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_B = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


_written: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder that the cluster names in
    ``spark.checkpoint.dir`` (a default only where it is unset) and read it.
    A written table also has true sizes, which long chains of joins over
    checkpointed frames would lose.  The write's shuffle files go as soon as
    it has ended; ``release`` and ``drop_written`` remove the table's files."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*frames: DataFrame) -> None:
    """Remove tables of ``cut`` from which nothing is read any more."""
    for df in frames:
        _written.remove((df.sparkSession, df._cut_path))
        _remove(df.sparkSession, df._cut_path)


def drop_written() -> None:
    """Remove the tables that ``cut`` has written in this process; nothing
    made from them can be read afterwards."""
    while _written:
        try:
            _remove(*_written.pop())
        except Exception:  # noqa: BLE001  the session has ended
            pass


atexit.register(drop_written)


def row_key(*cols):
    """A deterministic 64-bit key of a row.  Rows equal in ``cols`` share it;
    the operators treat such rows alike, so that does no harm."""
    return F.xxhash64(*[x for c in cols for x in (F.isnull(c), c)])


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``pos``, the place of a row in its group by ``order`` (from
    0, nulls first), and ``of``, the rows of its group.

    Rows are range-partitioned and sorted; each partition counts its own rows,
    and only the counts of partitions meet in a window, so neither a group nor
    equal rows need fit into one task.  Rows equal in all of ``group`` and
    ``order`` are numbered in any order.  The numbered rows are written once.
    """
    seq = F.monotonically_increasing_id()
    rows = cut(df.withColumn("__salt", seq).repartitionByRange(*group, *order, "__salt")
               .sortWithinPartitions(*group, *order).drop("__salt")
               .withColumn("__part", F.spark_partition_id())
               .withColumn("__seq", seq.bitwiseAND(F.lit((1 << 33) - 1))))
    parts = rows.groupBy(*group, "__part").agg(F.min("__seq").alias("least"), F.count(F.lit(1)).alias("many"))
    whole = Window.partitionBy(*group)
    before = F.sum("many").over(whole.orderBy("__part")) - F.col("many")
    parts = parts.select(*group, "__part", (before - F.col("least")).alias("__shift"), F.sum("many").over(whole).alias("of"))
    return (rows.join(parts, [*group, "__part"])
            .select(*df.columns, (F.col("__seq") + F.col("__shift")).alias("pos"), "of"))


def worker_memo(owner: str, key, make):
    """An object that tasks which the Python worker runs later find again.
    Objects of one owner live at a time: when another one starts, the worker
    forgets them and gives their memory back."""
    memo = sys.__dict__.setdefault("_quarry_llm_memo", {})
    if memo.get("owner") != owner:
        if memo:
            memo.clear()
            give_back()
        memo["owner"] = owner
    if ("of", key) not in memo:
        memo["of", key] = make()
    return memo["of", key]


def give_back() -> None:
    """Return what the worker no longer uses: Arrow's pool and the C library
    keep freed memory otherwise, and later tasks of any operator pay for it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):       # no such C library: the memory is used again, not returned
        pass


def forget() -> None:
    """Let go of what ``worker_memo`` keeps and give it back, where the steps
    that follow don't need it: idle workers wait beside the JVM's joins."""
    sys.__dict__.get("_quarry_llm_memo", {}).clear()
    give_back()


def texts_of(column):
    """The texts of a column; only a few at a time are Python strings."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


class _WordHashes(dict):
    size = 0

    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < LONG_WORD:
            if self.size >= CACHE_BYTES:
                self.clear()
                self.size = 0
            self[word] = h
            self.size += len(word) + ENTRY_BYTES
        return h


def words(text: str | None, lower: bool = False) -> list[bytes]:
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    memo = worker_memo("words", "hashes", _WordHashes)
    return np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(a: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash (base ``_B`` modulo 2**64) of every ``k`` consecutive
    values, built from runs of doubled length; then mixed."""
    n = len(a) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, acc = 0, None          # hash of the first ``done`` values from each start
    run, size = a, 1             # hash of runs of ``size`` values
    left = k
    while left:
        if left & 1:
            if acc is None:
                acc, done = run, size
            else:
                m = len(run) - done
                acc = acc[:m] * np.uint64(pow(_B, size, 1 << 64)) + run[done:done + m]
                done += size
        left >>= 1
        if left:
            run = run[:-size] * np.uint64(pow(_B, size, 1 << 64)) + run[size:]
            size *= 2
    return mix(acc[:n])


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    if len(a) < w:
        return a[:0]
    size, run = 1, a
    while size * 2 <= w:
        run = np.minimum(run[:-size], run[size:])
        size *= 2
    return np.minimum(run[:len(a) - w + 1], run[w - size:w - size + len(a) - w + 1])


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of a shorter
    sequence, one hash of the whole; of none, nothing."""
    n = len(hashes)
    if not n:
        return hashes
    if n < k:
        return mix(rolling(hashes, n) + np.uint64(n))
    return np.unique(rolling(hashes, k))


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` longs to ``(node, label)``: the smallest node reachable.

    Each round takes the smallest label among the neighbours, then follows
    the label's own label (pointer jumping), so long chains shrink fast.
    Every round's labels are written; only the number of changed labels
    reaches the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
               .filter("a <> b").distinct())
    lab = cut(both.groupBy(F.col("a").alias("node"))
              .agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = (both.join(lab.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        step = lab.join(near, "node").select("node", F.col("label").alias("old"),
                                             F.least("label", "near").alias("label"))
        up = lab.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = cut(step.join(up, "label").select("node", "old", F.least("label", "up").alias("label")))
        moved = new.filter("old <> label").count()
        lab = new.select("node", "label")
        if not moved:
            return lab
