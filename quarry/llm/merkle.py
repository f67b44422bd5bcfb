"""Merkle manifest of a dataset, as a persistent tree.

Each row is a leaf; the leaves of a source stand by ``doc_id`` (null first),
and every 16 consecutive nodes become one until one remains, the source's
subroot.  The subroots, by source (null first, bytewise), form a tree of the
same kind up to the root.

* Leaves are numbered without one task a source (``common.numbered``) and cut
  into aligned blocks of 16**3.  A block is one piece of work: its tree has
  three levels, or fewer where it holds the whole source.  The roots of blocks
  are nodes of the next round, so rounds grow with the logarithm of the rows.
* Downwards, each block gets the siblings from its root up to the tree's root
  as a header row, sorted before its leaves.
* A changed leaf makes a version of its block's tree: only the path from the
  leaf to the block's root is copied, all other nodes are the tree's own.  The
  version goes on above the block by the header's siblings, up to its own root.

At most one block, its header and one Arrow batch are in memory.  Null columns
are leaves with ``-`` in their place; empty and long texts need nothing
special.  Repeated rows, and rows that share a ``doc_id`` or have none, are
leaves of their own, in the order of their digests.  A row without ``doc_id``
is not tampered with.  An empty table gives an empty result.  Other columns of
the table are left alone.
"""

from __future__ import annotations

import hashlib
import string
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from .common import cut, numbered

FANOUT = 16
HEIGHT = 3
BLOCK = FANOUT ** HEIGHT
BATCH = 2048        # rows of a result batch


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


class Tree:
    """``levels[0]`` are the nodes; every run of 16 nodes of a level has one
    node in the next.  It ends with one node, or at ``height``."""

    def __init__(self, nodes: list[str], height: int | None = None):
        self.levels = [nodes]
        while len(self.levels[-1]) > 1 if height is None else len(self.levels) <= height:
            below = self.levels[-1]
            self.levels.append([digest("".join(below[at:at + FANOUT])) for at in range(0, len(below), FANOUT)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, pos: int, start: int = 0, end: int = -1) -> list[str]:
        """From level ``start`` upwards: those before the node, those after it."""
        out = []
        for level in self.levels[start:-1][:end if end > 0 else None]:
            first = pos - pos % FANOUT
            out += ["".join(level[first:pos]), "".join(level[pos + 1:first + FANOUT])]
            pos //= FANOUT
        return out


class Version:
    """A tree with another leaf: its own nodes are the path above that leaf,
    every other node is that of ``base``."""

    def __init__(self, base: Tree, pos: int, leaf: str):
        self.base, self.copied = base, {(0, pos): leaf}
        for height in range(len(base.levels) - 1):
            first = pos - pos % FANOUT
            run = [self.node(height, at) for at in range(first, min(first + FANOUT, len(base.levels[height])))]
            pos //= FANOUT
            self.copied[height + 1, pos] = digest("".join(run))

    def node(self, height: int, pos: int) -> str:
        return self.copied.get((height, pos)) or self.base.levels[height][pos]

    @property
    def root(self) -> str:
        return self.node(len(self.base.levels) - 1, 0)


def climb(node: str, path: list[str]) -> list[str]:
    """The node and its successors along the siblings of ``path``."""
    out = [node]
    for at in range(0, len(path), 2):
        out.append(digest(path[at] + out[-1] + path[at + 1]))
    return out


def field(c: str | Column) -> Column:
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf_digest(*cols) -> Column:
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _rows(batches):
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _in_blocks(df: DataFrame, work, schema: str) -> DataFrame:
    """``work(g, block, rows by pos)`` makes result rows of each block of
    ``df``, whose first columns are ``g, block, pos``."""
    arrow = to_arrow_schema(DataType.fromDDL(schema))

    def run(batches):
        made = (row for (g, block), rows in groupby(_rows(batches), key=itemgetter(0, 1)) for row in work(g, block, rows))
        while held := list(islice(made, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)

    return df.repartition("g", "block").sortWithinPartitions("g", "block", "pos").mapInArrow(run, schema)


def _height(of: int) -> int | None:
    return HEIGHT if of > BLOCK else None


def _roots(nodes: DataFrame) -> DataFrame:
    """``(g, pos, of, digest)`` of blocks' roots from those of their nodes."""
    def work(g, block, rows):
        rows = list(rows)
        of = rows[0][3]
        yield g, block, -(-of // BLOCK), Tree([r[4] for r in rows], _height(of)).root

    block = F.expr(f"pos div {BLOCK}").alias("block")
    return _in_blocks(nodes.select("g", block, "pos", "of", "digest"), work, "g string, pos long, of long, digest string")


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, their blocks' roots, and so on up to one node a group."""
    out = [nodes]
    while True:
        out.append(cut(_roots(out[-1])))
        if out[-1].filter("of > 1").isEmpty():
            return out


def _headed(nodes: DataFrame, above: DataFrame, columns: str) -> DataFrame:
    """Nodes by block, with the block's row of ``above`` (``g, pos, path,
    subroot``) as header at place -1."""
    block = F.expr(f"pos div {BLOCK}").alias("block")
    body = nodes.select("g", block, "pos", *[c.strip() for c in columns.split(",")],
                        F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"))
    head = above.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "subroot")
    return body.unionByName(head, allowMissingColumns=True)


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``(g, pos, path, subroot)`` of nodes: their siblings up to the root."""
    def work(g, block, rows):
        head, rows = next(rows), list(rows)
        tree = Tree([r[4] for r in rows], _height(rows[0][3]))
        for at, r in enumerate(rows):
            yield g, r[2], tree.siblings(at) + head[5], head[6]

    return _in_blocks(_headed(nodes, above, "of, digest"), work, "g string, pos long, path array<string>, subroot string")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified,
    copied)`` of every row.

    Rows where ``tampered`` (a condition on the columns of ``docs``) holds have
    the letters A-Z of their text lowered before they are folded; ``copied``
    holds the nodes of their version that are not the tree's own, from the leaf
    to the version's root, and is null for other rows.
    """
    text = F.col("text").cast("string")
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    # sources by text, null first
    g = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    rows = docs.select(
        g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest("doc_id", "source", "lang", "n_chars", text).alias("digest"),
        F.when(tampered, leaf_digest("doc_id", "source", "lang", "n_chars", lower_ascii(text))).alias("other"))
    # range partitioning reads its input twice: texts are hashed once
    leaves = numbered(cut(rows), ["g"], ["doc_id", "digest"])
    levels = _levels(leaves)
    subroots = levels[-1].select(F.lit("").alias("g"), F.col("g").alias("source"), "digest")
    sources = numbered(subroots, ["g"], ["source"])
    upper = _levels(sources)
    top = upper[-1].first()
    root = top.digest if top else None

    above = upper[-1].select("g", "pos", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"))
    for nodes in reversed(upper[:-1]):
        above = cut(_paths(nodes, above))
    above = (above.drop("g", "subroot").join(sources.select("pos", "source", F.col("digest").alias("subroot")), "pos")
             .select(F.col("source").alias("g"), F.lit(0).cast("long").alias("pos"), "path", "subroot"))
    for nodes in reversed(levels[1:-1]):
        above = cut(_paths(nodes, above))

    def work(g, block, rows):
        _, _, _, _, _, _, _, path, subroot = next(rows)
        rows = list(rows)
        tree = Tree([r[5] for r in rows], _height(rows[0][3]))
        tails = {}
        for at, (_, _, _, _, doc_id, leaf, other, _, _) in enumerate(rows):
            run = at // FANOUT
            if run not in tails:
                tails[run] = "".join(tree.siblings(run, 1) + path)
            proof = digest("".join(tree.siblings(at, end=1)) + tails[run])
            version = Version(tree, at, other or leaf)
            upwards = climb(version.root, path)
            copied = None if other is None else list(version.copied.values()) + upwards[1:]
            yield doc_id, leaf, subroot, root, proof, upwards[-1], upwards[-1] == root, copied

    return _in_blocks(_headed(leaves, above, "of, doc_id, digest, other"), work,
                      "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
                      "verified boolean, copied array<string>")
