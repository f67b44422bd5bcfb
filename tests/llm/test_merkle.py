"""The Merkle manifest against a plain version that builds every tree whole."""

import hashlib
import random
import zlib

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from llm_fixtures import SCHEMA, frame, lower, rows
from quarry.llm import merkle
from quarry.llm.queries import op12_merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def fields(r, text):
    values = (r[0], r[3], r[2], r[4], text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def path_and_root(nodes, pos):
    """Runs (with the place of the node in them) from a node to the root."""
    runs = []
    while len(nodes) > 1:
        first = pos // 16 * 16
        runs.append((nodes[first:first + 16], pos - first))
        nodes = [h(*nodes[at:at + 16]) for at in range(0, len(nodes), 16)]
        pos //= 16
    return runs, nodes[0]


def plain(data):
    """Result rows of the manifest, sorted."""
    by_source = {}
    for r in data:
        by_source.setdefault(r[3], []).append((fields(r, r[1]), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by_source[s].sort(key=lambda e: (e[1][0] is not None, e[1][0] or 0, e[0]))
    subroots = [path_and_root([e[0] for e in by_source[s]], 0)[1] for s in names]
    out = []
    for i, s in enumerate(names):
        upper, root = path_and_root(subroots, i)
        leaves = [e[0] for e in by_source[s]]
        for at, (leaf, r) in enumerate(by_source[s]):
            runs = path_and_root(leaves, at)[0] + upper
            proof = h(*[n for run, k in runs for j, n in enumerate(run) if j != k])
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            node = fields(r, lower(r[1])) if hit else leaf
            for run, k in runs:
                node = h(*run[:k], node, *run[k + 1:])
            out.append((r[0], leaf, subroots[i], root, proof, node, node == root))
    return sorted(out, key=repr)


def tampered():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def result(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.manifest(df, tampered()).select(*cols).collect()), key=repr)


def test_hostile_table(spark):
    assert result(frame(spark)) == plain(rows())


@pytest.mark.parametrize("sizes", [(1,), (16, 17), (4096, 4097, 1), (9000, 300, 256)])
def test_blocks_and_levels(spark, sizes):
    """Sources of one leaf, whole runs, whole blocks and one leaf more."""
    rng = random.Random(4)
    data = [(i * 10 + s, rng.choice(["Abc", "x", None]), "en", f"s{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    assert result(frame(spark, data=data)) == plain(data)


def test_many_sources(spark):
    data = [(i, "T", None, f"host{i % 5000}", 1) for i in range(5300)]
    assert result(frame(spark, data=data)) == plain(data)


def test_equal_rows_and_empty_table(spark):
    """A hot group of rows equal in every column, without an id, over two blocks."""
    data = [(None, "Same", "en", "a", 4)] * 4500 + [(3, "B", "en", "b", 1)] * 40
    assert result(frame(spark, data=data)) == plain(data)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), tampered()).collect() == []


def test_versions_copy_paths_only(spark):
    """A version's own nodes are one a level; untouched nodes are the tree's."""
    tree = merkle.Tree([h(str(i)) for i in range(700)])
    version = merkle.Version(tree, 300, h("new"))
    assert list(version.copied) == [(0, 300), (1, 18), (2, 1), (3, 0)]
    changed = [h(str(i)) if i != 300 else h("new") for i in range(700)]
    assert version.root == merkle.Tree(changed).root != tree.root
    assert version.node(1, 17) is tree.levels[1][17]
    got = merkle.manifest(frame(spark, data=[(0, "ABC", "en", "a", 1)] + [(i, "q", "en", "a", 1) for i in range(1, 40)]),
                          F.col("doc_id") == 0).filter("copied is not null").collect()
    assert [(r.doc_id, len(r.copied), r.copied[-1] == r.folded_root, r.verified) for r in got] == [(0, 3, True, False)]


def test_query(spark):
    data = [(r.doc_id, r.text, r.lang, r.source, r.n_chars)
            for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op12_merkle(spark, SF_SMALL).collect()), key=repr)
    assert got == plain(data)
