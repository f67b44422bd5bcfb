import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import jaccard_join, substring_dedup
from quarry.llm.queries import op4_jaccard_join, op7_substring_dedup

from conftest import SF_SMALL
import llm_fixtures as fx


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 60)])
def test_components_equal_all_pairs(spark, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 4)      # so that the order has all three ranks
    got = jaccard_join.jaccard_components(fx.frame(spark), shingle=k, percent=percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(fx.jaccard_components(fx.rows(), k, percent))
    # one document of each component is kept, and every one without words
    comps = {r.component_id for r in got if r.n_shingles and r.doc_id is not None}
    kept = [r for r in got if r.kept and r.n_shingles]
    assert comps == {r.component_id for r in kept if r.component_id is not None}
    assert len({r.rid for r in kept}) == len(comps) + sum(1 for r in kept if r.component_id is None)


def test_copies_at_every_distance(spark, monkeypatch):
    """Copies with all shares of changed words, of texts over few words: sets
    overlap behind their prefixes, and lone shingles stand at all places."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 6)
    rng = random.Random(5)
    base = [[f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(8, 90))] for _ in range(12)]
    data = []
    for i in range(300):
        share = rng.random() * 0.5
        ws = [w if rng.random() > share else f"w{rng.randint(0, 2000)}" for w in rng.choice(base)]
        data.append((i, " ".join(ws)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for k, percent in ((1, 60), (2, 50)):
        got = jaccard_join.jaccard_components(docs, shingle=k, percent=percent).collect()
        assert (Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)
                == Counter(fx.jaccard_components(data, k, percent)))


def test_bit_maps_refuse_no_link():
    rng = np.random.default_rng(3)
    for n in (1, 7, 40, 333, 5000):
        for share in (0.0, 0.05, 0.1, 0.3, 1.0):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.unique(np.concatenate((x[rng.random(len(x)) >= share], rng.integers(0, 1 << 63, int(n * share * 2)).astype(np.uint64))))
            if not len(y):
                continue
            inter = len(np.intersect1d(x, y))
            links = 100 * inter >= 85 * (len(x) + len(y) - inter)
            may = jaccard_join.may_overlap(jaccard_join.bit_map(x), jaccard_join.bit_map(y), len(x), len(y), 85)
            assert may or not links


def test_windows_equal_brute_force(spark):
    for w, a in ((35, 8), (5, 2), (6, 6)):
        got = substring_dedup.remove_repeats(fx.frame(spark), window=w, anchor=a).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == Counter(fx.removed(fx.rows(), w))
        for r in got:      # intervals are maximal and sum up
            assert sum(z - y for y, z in r.spans) == r.n_removed
            assert all(x[1] < y[0] for x, y in zip(r.spans, r.spans[1:]))


def test_random_tables(spark):
    for seed in (11, 12):
        data = fx.rows(seed, 60)
        got = substring_dedup.remove_repeats(fx.frame(spark, data=data), digest=True).collect()
        assert Counter((r.doc_id, r.kept_sha256) for r in got) == Counter((i, fx.sha(t)) for i, _, _, t in fx.removed(data, 35))


def test_empty_table(spark):
    empty = fx.frame(spark).limit(0)
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_queries_on_given_table(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = op4_jaccard_join(spark, SF_SMALL).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(fx.jaccard_components(data, 4, 85))
    got = op7_substring_dedup(spark, SF_SMALL).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == \
        Counter((i, n, m, fx.sha(t)) for i, n, m, t in fx.removed(data, 35))
