"""Substring de-duplication by Rabin-Karp hashes of fixed-length windows.

Every window of ``window`` consecutive words has a Rabin-Karp hash.  A window
can only be repeated if its anchor is: the smallest hash among the ``anchor``-
word runs inside it.  So the count runs in two steps, each a plain grouped
count with map-side partial sums:

1. Count the anchors (about one in fourteen windows starts a new one).  An
   anchor counted once proves all its windows unique; these go back to their
   one owner.
2. Count the Rabin-Karp hashes of all other windows.  Those counted once go
   back to their owner too; all that remain are repeated.

Repeated windows of a document are merged into maximal removal intervals.
Only what is unique travels back, and a unique thing has one owner, so no
frequent passage makes a hot key or group.

Windows are judged on the input.  A null or empty text has no words; texts
with fewer words than the window lose nothing; equal rows count as several
documents, so their windows are repeated; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rolling, row_key, sliding_min, word_hashes, words

WINDOW = 35
ANCHOR = 8


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _list(column, i) -> np.ndarray:
    """The longs of row ``i`` of a list column, as unsigned values."""
    v = column[i].values
    return np.empty(0, np.uint64) if v is None else v.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def anchors_of(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchor-length runs, and of each window its anchor."""
    runs = rolling(hashes, anchor)
    return runs, sliding_min(runs, window - anchor + 1)


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words a window that starts in ``starts`` covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs ``[start, end)`` of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def unique_anchors(keyed: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(rid, lone)``: the anchors that occur once in all texts, by owner."""
    def spread(batches):
        for b in batches:
            rids = b.column(0).to_numpy()
            out, own, twice = [], [], []
            for rid, t in zip(rids, b.column(1).to_pylist()):
                h = word_hashes(words(t))
                if len(h) < window:
                    continue
                runs, mins = anchors_of(h, window, anchor)
                vals = np.unique(mins)
                u, c = np.unique(runs, return_counts=True)
                out.append(vals)
                twice.append(np.minimum(c[np.searchsorted(u, vals)], 2))
                own.append(np.full(len(vals), rid, np.int64))
            if out:
                yield pa.record_batch({"anchor": _as_long(np.concatenate(out)),
                                       "n": pa.array(np.concatenate(twice), pa.int64()),
                                       "rid": pa.array(np.concatenate(own), pa.int64())})

    return (keyed.select("rid", "__text").mapInArrow(spread, "anchor long, n long, rid long")
            .groupBy("anchor").agg(F.sum("n").alias("n"), F.min("rid").alias("rid"))
            .filter("n = 1").groupBy("rid").agg(F.collect_list("anchor").alias("lone")))


def unique_windows(joined: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(rid, single)``: starts of the windows with a shared anchor whose
    Rabin-Karp hash is counted once all the same, by owner."""
    at = {c: i for i, c in enumerate(joined.columns)}

    def spread(batches):
        for b in batches:
            rids = b.column(at["rid"]).to_numpy()
            lone = b.column(at["lone"])
            out, own, pos, size = [], [], [], 0
            for i, (rid, t) in enumerate(zip(rids, b.column(at["__text"]).to_pylist())):
                h = word_hashes(words(t))
                if len(h) < window:
                    continue
                _, mins = anchors_of(h, window, anchor)
                shared = np.flatnonzero(~np.isin(mins, _list(lone, i)))
                if not len(shared):
                    continue
                out.append(rolling(h, window)[shared])
                own.append(np.full(len(shared), rid, np.int64))
                pos.append(shared)
                size += len(shared)
                if size >= 1 << 19:
                    yield batch(out, own, pos)
                    out, own, pos, size = [], [], [], 0
            if out:
                yield batch(out, own, pos)

    def batch(out, own, pos):
        return pa.record_batch({"hash": _as_long(np.concatenate(out)),
                                "rid": pa.array(np.concatenate(own), pa.int64()),
                                "pos": pa.array(np.concatenate(pos).astype(np.int32), pa.int32())})

    return (joined.mapInArrow(spread, "hash long, rid long, pos int")
            .groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid"), F.min("pos").alias("pos"))
            .filter("n = 1").groupBy("rid").agg(F.collect_list("pos").alias("single")))


def remove_repeats(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), window: int = WINDOW,
                   anchor: int = ANCHOR, digest: bool = False, verbatim: bool = False) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_removed``, the removed ``spans``
    (maximal word intervals, end excluded) and the ``kept`` text: its words
    joined by one space (with ``digest``, its SHA-256 instead of the two; with
    ``verbatim``, a text that loses nothing as it came).
    """
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    ids = [c for c in keep if c != text]
    keyed = docs.select(row_key(*ids, text).alias("rid"), *ids, F.col(text).cast("string").alias("__text"))
    joined = keyed.join(unique_anchors(keyed, window, anchor), "rid", "left")
    judged = joined.join(unique_windows(joined, window, anchor), "rid", "left")
    at = {c: i for i, c in enumerate(judged.columns)}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ids] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
        + ([T.StructField("kept_sha256", T.StringType())] if digest else
           [T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("kept", T.StringType())]))

    def judge(batches):
        for b in batches:
            lone, single = b.column(at["lone"]), b.column(at["single"])
            n_words, n_removed, kept, spans = [], [], [], []
            for i, t in enumerate(b.column(at["__text"]).to_pylist()):
                ws = words(t)
                n, out = len(ws), ws
                gone = np.zeros(n, bool)
                if n >= window:
                    _, mins = anchors_of(word_hashes(ws), window, anchor)
                    shared = ~np.isin(mins, _list(lone, i))
                    shared[_list(single, i).view(np.int64)] = False
                    starts = np.flatnonzero(shared)
                    if len(starts):
                        gone = covered(starts, n, window)
                        out = [ws[j] for j in np.flatnonzero(~gone).tolist()]
                n_words.append(n)
                n_removed.append(n - len(out))
                joined_words = b" ".join(out)
                if verbatim and not gone.any():
                    kept.append(t)
                    spans.append([])
                elif digest:
                    kept.append(hashlib.sha256(joined_words).hexdigest())
                else:
                    kept.append(joined_words.decode("utf-8", "surrogatepass"))
                    spans.append([list(s) for s in intervals(gone)])
            cols = [b.column(at[c]) for c in ids] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            if not digest:
                cols.append(pa.array(spans, pa.list_(pa.list_(pa.int32()))))
            cols.append(pa.array(kept, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return judged.mapInArrow(judge, schema)
