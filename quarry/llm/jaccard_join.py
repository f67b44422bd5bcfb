"""N-gram Jaccard join: grouped prefix join.

A document's set are the distinct hashes of its word shingles.  Documents
with equal sets form one class; classes with equal prefix and size form one
group.  Prefixes follow one global order of the shingles: by hash, but with
the frequent ones last (a bounded table, counted over all texts).  Any order
gives exact results; this one keeps passages that many documents share out of
the prefixes.

Two sets with Jaccard similarity of ``t`` or more share a shingle of their
prefixes (size - ceil(t * size) + 1), so pairs are looked for among groups
that share one, filtered by size and position, expanded to their member
classes, filtered by bit maps of the whole sets (a bound on the overlap, so no
link is lost) and verified on the whole sets.  To keep large clusters from
giving all their pairs, that happens in rounds:

* First each group's classes are compared with its first class, and the groups
  that share a prefix shingle with a fixed number of them (PIVOTS, chosen by
  hash).  Of a class's partners, the NEAREST by shared prefix shingles are held
  against the bit maps, and what those leave is verified.
  TURNS such rounds compare only what is not in one component yet.
* The last round compares everything that shares a prefix shingle (or a group)
  and is not in one component yet.  Where many rows meet at a shingle, the whole
  sets of its classes are counted first: a shingle that no other group there has is in
  no overlap, so a text whose edits stand alone meets none of a crowd that it cannot link with.

A pair that the last round leaves out is in one component already, so components are
exact.  Null, empty and blank texts have an empty set and link with nothing;
a text shorter than a shingle is one shingle; repeated rows are one class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import setting

from .common import components, cut, forget, give_back, mix, release, row_key, shingles, texts_of, word_hashes, words

SHINGLE, PERCENT = 4, 85
FREQUENT = 16           # documents from which on a shingle comes last
CHUNK = 8 << 20         # shingles that a task counts at a time
FREQUENT_MAX = 1 << 20  # size bound of the broadcast table of frequent ones
PIVOTS, TURNS = 24, 2      # members that are compared with all others, and how often anew
NEAREST = 8             # partners of a class that a turn compares; the last round takes all
BITS = 4                # places of a bit map a shingle, at least
BROADCAST_ROWS = 1 << 20   # up to so many wanted rows are broadcast, else shuffled
CROWD = 64              # rows of a shingle from which on its classes are counted by their whole sets first
#: Texts, sets and bit maps meet Python in batches of so many bytes: Spark's writer, the worker's Arrow and its
#: objects each hold a batch, in every task at once, and freed blocks of many MB stay with the process.
BATCH_BYTES = 2 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def class_id(s: np.ndarray) -> int:
    """A 64-bit id of a set of hashes and its size."""
    a = np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)), np.bitwise_xor.reduce(mix(s))], np.uint64)
    h = mix(a)
    return int(mix(h[:1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[0].view(np.int64))


def bit_map(s: np.ndarray) -> np.ndarray:
    """The places that the hashes fall on, a power of two, as packed bits."""
    places = max(64, 1 << (BITS * len(s) - 1).bit_length())
    bits = np.zeros(places, np.uint8)
    bits[(s & np.uint64(places - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def may_overlap(x: np.ndarray, y: np.ndarray, nx: int, ny: int, percent: int) -> bool:
    """Can sets with these bit maps and sizes link?  A place that only one set
    falls on holds a shingle that the other lacks."""
    size = min(len(x), len(y))
    x = np.bitwise_or.reduce(x.reshape(-1, size), axis=0)    # fold the larger map
    y = np.bitwise_or.reduce(y.reshape(-1, size), axis=0)
    most = min(nx - int(np.bitwise_count(x & ~y).sum()), ny - int(np.bitwise_count(y & ~x).sum()))
    return (100 + percent) * most >= percent * (nx + ny)


def _short(s: np.ndarray) -> np.ndarray:
    """32 bits of a hash: enough to count by, as counts only set the order."""
    return (s >> np.uint64(32)).astype(np.uint32)


def _order(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles in the global order; ``s`` is sorted by hash."""
    if not len(often):
        return s
    short = _short(s)
    last = often[np.minimum(np.searchsorted(often, short), len(often) - 1)] == short
    return np.concatenate((s[~last], s[last]))


def repeats(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that stand in ``a`` more than once, and how often; sorts
    ``a``.  Beside it, three marks a value are all that memory has to hold."""
    a.sort()
    same = np.zeros(len(a) + 1, bool)           # is a value that of the one before?
    np.equal(a[1:], a[:-1], out=same[1:-1])
    first = np.flatnonzero(same[1:] & ~same[:-1])
    last = np.flatnonzero(same[:-1] & ~same[1:])
    return a[first], last - first + 1


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that many documents have, at most FREQUENT_MAX.  Every text is
    counted; a task passes on what it has met at least twice in CHUNK
    shingles, so the counts are lower bounds and little is shuffled."""
    def repeated(held):
        a = np.concatenate(held)
        held.clear()
        u, c = repeats(a)
        return pa.record_batch({"shingle": pa.array(u.view(np.int32), pa.int32()), "n": pa.array(c, pa.int64())})

    def rows(batches):
        held, size = [], 0
        for b in batches:
            for t in texts_of(b.column(0)):
                held.append(_short(shingles(word_hashes(words(t, lower=True)), k)))
                size += len(held[-1])
                if size >= CHUNK:
                    yield repeated(held)
                    size = 0
        if held:
            yield repeated(held)
        del held
        give_back()

    got = (docs.select("text").mapInArrow(rows, "shingle int, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
           .filter(F.col("n") >= FREQUENT)
           .orderBy(F.col("n").desc(), "shingle").limit(FREQUENT_MAX).select("shingle").toArrow())
    return np.sort(got.column(0).to_numpy().astype(np.int32).view(np.uint32))


def _coded(docs: DataFrame, k: int, percent: int, frequent) -> DataFrame:
    """``(doc_id, rid, n, cid, gid, prefix, bits)`` of every row, in one pass
    over the texts; rows without words have only the first three."""
    def rows(batches):
        often = frequent.value
        for b in batches:
            cids, ns, gids, prefixes, bits = [], [], [], [], []
            for t in texts_of(b.column(2)):
                s = shingles(word_hashes(words(t, lower=True)), k)
                n = len(s)
                ns.append(n)
                if not n:
                    for c in (cids, gids, prefixes, bits):
                        c.append(None)
                    continue
                p = _order(s, often)[:prefix_size(n, percent)]
                cids.append(class_id(s))
                gids.append(class_id(np.concatenate((p, [np.uint64(n)]))))
                prefixes.append(p.view(np.int64))
                bits.append(bit_map(s).tobytes())
            yield pa.record_batch({
                "doc_id": b.column(0), "rid": b.column(1), "n": pa.array(ns, pa.int64()), "cid": pa.array(cids, pa.int64()),
                "gid": pa.array(gids, pa.int64()), "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                "bits": pa.array(bits, pa.binary())})
        forget()

    return docs.select("doc_id", "rid", "text").mapInArrow(
        rows, "doc_id long, rid long, n long, cid long, gid long, prefix array<long>, bits binary")


def _may_link(a: str, b: str, percent: int) -> str:
    """Size filter, and bound on the overlap from the places of a shared
    shingle in both orders.  A shingle before it that no other group has in its
    prefix is not in the other set: there it would stand in the prefix too."""
    top = f"(least({a}.pos, {b}.pos) + least({a}.left, {b}.left))"
    return (f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and "
            f"{100 + percent} * {top} >= {percent} * ({a}.n + {b}.n)")


def _last():
    """Of a pair: its shared prefix shingles and what both have from the last on."""
    return F.count(F.lit(1)).alias("c"), F.min("la").alias("la"), F.min("lb").alias("lb")


def _enough(percent: int) -> str:
    """Bound on the overlap from those: what both have before the last shared
    prefix shingle is counted, what follows is at most the shorter rest."""
    return f"{100 + percent} * (c + least(la, lb) - 1) >= {percent} * (na + nb)"


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows whose shingle more than one component has."""
    ends = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return rows.join(ends.select("token"), "token", "left_semi")


def _of_ends(classes: DataFrame, pairs: DataFrame, *cols: str) -> DataFrame:
    """``(cid, <cols>)`` of the classes that the pairs ``(a, b)`` name."""
    ends = cut(pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct())
    if ends.count() <= BROADCAST_ROWS:        # a long a row
        ends = F.broadcast(ends)
    return classes.select("cid", *cols).join(ends, "cid")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose bit maps allow the overlap."""
    has = _of_ends(classes, pairs, "n", "bits")
    both = (pairs.join(has.selectExpr("cid a", "n na", "bits xa"), "a")
            .join(has.selectExpr("cid b", "n nb", "bits xb"), "b"))

    def check(batches):
        for b in batches:
            keep = [may_overlap(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), nx, ny, percent)
                    for x, y, nx, ny in zip(*[b.column(i).to_pylist() for i in range(2, 6)])]
            yield pa.record_batch({"a": b.column(0), "b": b.column(1)}).filter(pa.array(keep, pa.bool_()))
        give_back()

    return both.select("a", "b", "xa", "xb", "na", "nb").mapInArrow(check, "a long, b long")


def _sets(wanted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``(cid, set)``: the whole sets of the classes ``(cid, rid)``."""
    wanted = cut(wanted)
    if wanted.count() <= BROADCAST_ROWS:      # two longs a row
        wanted = F.broadcast(wanted)
    # rows equal in key and text share the rid: one of them is enough
    texts = docs.select("rid", "text").join(wanted, "rid").select("cid", "text").dropDuplicates(["cid"])

    def sets(batches):
        for b in batches:
            got = [shingles(word_hashes(words(t, lower=True)), k).tobytes() for t in texts_of(b.column(1))]
            yield pa.record_batch({"cid": b.column(0), "set": pa.array(got, pa.binary())})
        forget()

    return texts.mapInArrow(sets, "cid long, set binary")


def _crowded(rows: DataFrame, shared: DataFrame, member: DataFrame, classes: DataFrame, docs: DataFrame,
             k: int, percent: int) -> DataFrame:
    """Rows ``(token, gid, n, left, pos, comp)`` with ``rest``: for the groups that
    have a token of many rows, a bound on the shingles from this one on (in the
    global order) that any other of these groups has; null for all others.

    Those groups' whole sets are counted; a shingle is common where two of the
    groups have it.  Rows of such a token go where the bound allows no link."""
    crowds = cut(rows.groupBy("token").count().filter(F.col("count") > CROWD).select("token"))
    if crowds.isEmpty():
        return rows.withColumn("rest", F.lit(None).cast("long"))
    there = cut(rows.join(crowds, "token", "left_semi").select("gid").distinct())
    some = cut(member.join(there, "gid"))
    has = _sets(classes.select("cid", "rid").join(some.select("cid"), "cid"), docs, k)

    def listed(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                many = np.array([len(x) for x in sets])
                yield pa.record_batch({"cid": part.column(0).take(pa.array(np.repeat(np.arange(len(sets)), many))),
                                       "token": pa.array(np.concatenate(sets))})
        give_back()

    spread = cut(has.mapInArrow(listed, "cid long, token long").join(some, "cid").select("token", "gid", "comp", "cid"))
    common = cut(spread.groupBy("token").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi"))
                 .filter("lo <> hi").select("token"))
    many = (spread.join(common, "token", "left_semi").groupBy("gid", "comp", "cid").count()
            .groupBy("gid", "comp").agg(F.max("count").alias("many")))
    before = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("left"))) - 1
    places = (shared.join(there, "gid", "left_semi").join(common, "token", "left_semi")
              .select("token", "gid", before.alias("before")))
    # (a token that is not common there, and a group without any, get 0)
    rest = F.coalesce(F.col("many") - F.col("before"), F.lit(0))
    out = cut(rows.join(places, ["token", "gid"], "left").join(many, ["gid", "comp"], "left")
              .join(there.withColumn("there", F.lit(True)), "gid", "left")
              .join(crowds.withColumn("crowd", F.lit(True)), "token", "left")
              .withColumn("rest", F.when(F.col("there"), rest).cast("long"))
              .filter(F.col("crowd").isNull() | F.expr(f"100 * rest >= {percent} * n"))
              .select(*rows.columns, "rest"))
    release(spread)
    return out


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose whole sets are similar enough."""
    has = cut(_sets(_of_ends(classes, pairs, "rid"), docs, k))
    both = (pairs.join(has.select(F.col("cid").alias("a"), F.col("set").alias("sa")), "a")
            .join(has.select(F.col("cid").alias("b"), F.col("set").alias("sb")), "b"))

    def verify(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.record_batch({"a": b.column(0), "b": b.column(1)}).filter(pa.array(keep, pa.bool_()))
        give_back()

    out = cut(both.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long").distinct())
    release(has)
    return out


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
                       percent: int = PERCENT) -> DataFrame:
    """``(key, n_shingles, component_id, kept, rid)`` of every row.

    ``component_id`` is the smallest key that links reach; ``kept`` marks the
    rows of one document in each component (that with the smallest key, null
    last); ``rid`` is ``row_key(key, text)``."""
    # every step in Python ends in a table that is written here
    with setting(docs.sparkSession, ARROW_BYTES, str(BATCH_BYTES)):
        return _components(docs, text, key, shingle, percent)


def _components(docs: DataFrame, text: str, key: str, shingle: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("rid", row_key("doc_id", "text"))
    often = spark.sparkContext.broadcast(_frequent(docs, shingle))
    coded = cut(_coded(docs, shingle, percent, often))
    # one row per distinct set; its rid names a row that has the set
    classes = cut(coded.filter("cid is not null").drop("doc_id").dropDuplicates(["cid"]))
    rows = cut(coded.select("doc_id", "rid", "n", "cid"))
    release(coded)

    groups = cut(classes.groupBy("gid").agg(F.min("cid").alias("rep")))
    one = classes.alias("c").join(groups.alias("g"), F.expr("c.gid = g.gid and c.cid = g.rep"), "left_semi")
    tokens = one.select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    # one shuffle by shingle; a row that stands alone is no group's neighbour
    by = Window.partitionBy("token").orderBy("gid")
    shared = (tokens.withColumn("near", F.coalesce(F.lag("gid").over(by), F.lead("gid").over(by)))
              .filter("near is not null").select("token", "gid", "n", "pos"))
    # "pos" now counts what other groups may have before the shingle, "left" all from it on
    before = F.row_number().over(Window.partitionBy("gid").orderBy("pos")) - 1
    shared = cut(shared.select("token", "gid", "n", (F.col("n") - F.col("pos")).alias("left"), before.alias("pos"))
                 .filter(f"100L * (pos + left) >= {percent}L * n"))
    member = classes.select("cid", "gid", F.col("cid").alias("comp"))
    edges = done = None

    # a few members of each group, and of those that share a shingle, with the others
    for turn in range(TURNS):
        parts = member.groupBy("gid", "comp").agg(F.min("cid").alias("cid"))
        if turn == 0:
            inside = (classes.alias("c").join(groups.alias("g"), F.expr("c.gid = g.gid and c.cid <> g.rep"))
                      .select(F.col("c.cid").alias("a"), F.col("g.rep").alias("b"), F.size("c.prefix").cast("long").alias("c")))
            parts = groups.select("gid", F.col("rep").alias("comp"), F.col("rep").alias("cid"))
        rows_ = _mixed(shared.join(parts, "gid"))
        turned = Window.partitionBy("token").orderBy(F.xxhash64(F.lit(turn), "gid", "comp"))
        rows_ = cut(rows_.withColumn("at", F.row_number().over(turned)))
        star = (rows_.alias("x").join(rows_.filter(F.col("at") <= PIVOTS).alias("y"), F.expr(
            f"x.token = y.token and x.at > y.at and x.comp <> y.comp and {_may_link('x', 'y', percent)}"))
            .selectExpr("x.cid a", "y.cid b", "x.n na", "y.n nb", "x.left la", "y.left lb")
            .groupBy("a", "b", "na", "nb").agg(*_last()).filter(_enough(percent)).select("a", "b", "c"))
        if turn == 0:
            star = star.union(inside)
        # of a class's partners, those with whom it shares most of the prefix are compared
        close = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))
        star = cut(star.withColumn("at", close).filter(F.col("at") <= NEAREST).select("a", "b"))
        maybe = cut(_possible(star, classes, percent))
        release(rows_)
        found = _verified(maybe, classes, docs, shingle, percent)
        near = star.selectExpr("least(a, b) a", "greatest(a, b) b")     # settled: refused or verified
        done = near if done is None else done.union(near)
        edges = found if edges is None else edges.union(found)
        label = components(edges)
        member = cut(classes.select("cid", "gid").join(label.withColumnRenamed("node", "cid"), "cid", "left")
                     .select("cid", "gid", F.coalesce("label", "cid").alias("comp")))

    # whatever shares a prefix shingle or a group and is not in one component yet
    parts = member.select("gid", "comp").distinct()
    split = parts.groupBy("gid").count().filter("count > 1").select("gid")
    apart = member.join(split, "gid")
    within = (apart.alias("x").join(apart.alias("y"), F.expr("x.gid = y.gid and x.comp < y.comp"))
              .select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")))
    rows_ = _crowded(cut(_mixed(shared.join(parts, "gid"))), shared, member, classes, docs, shingle, percent)
    # of a linked pair, what is left out is last in the order: _enough then holds at an earlier place
    across = (rows_.alias("x").join(rows_.alias("y"), F.expr(
        f"x.token = y.token and x.gid < y.gid and x.comp <> y.comp and {_may_link('x', 'y', percent)} and "
        f"(x.rest is null or y.rest is null or {100 + percent} * least(x.rest, y.rest) >= {percent} * (x.n + y.n))"))
        .selectExpr("x.gid ga", "x.comp ca", "y.gid gb", "y.comp cb", "x.n na", "y.n nb", "x.left la", "y.left lb")
        .groupBy("ga", "ca", "gb", "cb", "na", "nb").agg(*_last()).filter(_enough(percent)))
    across = (across.join(member.selectExpr("cid a", "gid ga", "comp ca"), ["ga", "ca"])
              .join(member.selectExpr("cid b", "gid gb", "comp cb"), ["gb", "cb"]).select("a", "b"))
    rest = cut(within.union(across).selectExpr("least(a, b) a", "greatest(a, b) b").distinct()
               .join(done.distinct(), ["a", "b"], "left_anti"))
    more = _verified(cut(_possible(rest, classes, percent)), classes, docs, shingle, percent)
    label = components(edges.union(more))

    # classes to rows
    firsts = (rows.filter("cid is not null").groupBy("cid")
              .agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "rid")).alias("first")))
    named = (firsts.join(label.withColumnRenamed("node", "cid"), "cid", "left")
             .select("cid", "first", F.coalesce("label", "cid").alias("label")))
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    named = named.join(least, "label").select("cid", "least")
    return rows.join(named, "cid", "left").select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("least.doc_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("least.rid") == F.col("rid"), F.lit(True)).alias("kept"), "rid")
