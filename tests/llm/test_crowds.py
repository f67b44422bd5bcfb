"""Many documents that share long passages and do not link."""

import sys
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm import jaccard_join as jj


def _sets(rows):
    out = {}
    for i, t in rows:
        ws = t.lower().split()
        out[i] = {tuple(ws[j:j + 4]) for j in range(len(ws) - 3)}
    return out


def test_a_crowd_that_does_not_link_meets_no_pairs(spark, monkeypatch):
    """Edits that stand alone were seen in prefixes only, so all of a crowd met each other in the last round."""
    base = [f"word{i}" for i in range(130)]
    rows = []
    for i in range(120):
        ws = list(base)
        for e in range(2 if i % 4 else 1):               # those with one edit link, the others do not
            ws[(17 * i + 23 * e) % 127 + 1] = f"own{i}x{e}"
        rows.append((i, " ".join(ws)))
    rows += [(200, " ".join(base[:50])), (201, "word1 word2 word3 word4 and others"), (202, None)]
    held, crowded = [], jj._crowded

    def seen(*args):
        held.append((args[0].count(), crowded(*args)))
        return held[-1][1]
    monkeypatch.setattr(jj, "_crowded", seen)
    monkeypatch.setattr(jj, "CROWD", 20)
    monkeypatch.setattr(jj, "PIVOTS", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jj.jaccard_components(docs).collect()}

    sets = _sets([(i, t) for i, t in rows if t])
    label = {i: i for i, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label and links
    [(before, out)] = held
    x, y = out.alias("x"), out.alias("y")
    met = x.join(y, F.expr(f"x.token = y.token and x.gid < y.gid and x.comp <> y.comp and {jj._may_link('x', 'y', 85)}"))
    pairs = met.filter("x.rest is null or y.rest is null or 185 * least(x.rest, y.rest) >= 85 * (x.n + y.n)")
    assert before and pairs.count() * 2 < met.count()


def test_texts_meet_python_in_small_batches(spark, monkeypatch):
    """near_duplicates of pipeline took more than 3000 MB of an executor: batches had 10,000 texts or sets."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(400)],
                                 "doc_id long, text string").coalesce(1)
    seen, write, before = [], jj.cut, spark.conf.get(jj.ARROW_BYTES, None)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"size": pa.array([b.nbytes], pa.int64())})

    def cut(df):
        seen.append([r.size for r in docs.select("text").mapInArrow(sizes, "size long").collect()] if not seen else
                    spark.conf.get(jj.ARROW_BYTES))
        return write(df)
    monkeypatch.setattr(jj, "cut", cut)
    monkeypatch.setattr(jj, "BATCH_BYTES", 1 << 17)
    assert jj.jaccard_components(docs).count() == 400
    assert len(seen[0]) > 4 and max(seen[0]) < 2 << 17 and set(seen[1:]) == {str(1 << 17)}
    assert spark.conf.get(jj.ARROW_BYTES, None) == before


def test_repeats_hold_little_beside_the_values():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 1000):
        for top in (1, 2, 40, 4000):
            a = r.integers(0, top, n).astype(np.uint32)
            u, c = np.unique(a, return_counts=True)
            got = jj.repeats(a.copy())
            assert got[0].tolist() == u[c > 1].tolist() and got[1].tolist() == c[c > 1].tolist()
    a = r.integers(0, 1 << 32, 1 << 20).astype(np.uint32)
    tracemalloc.start()
    jj.repeats(a)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < a.nbytes          # np.unique with counts takes several times as much


def test_workers_forget():
    common.word_hashes([b"one", b"two"])
    assert sys.__dict__["_quarry_llm_memo"]
    common.forget()
    assert not sys.__dict__["_quarry_llm_memo"]
    assert len(common.word_hashes([b"one"])) == 1
