"""Fingerprints, sharding, mixing, language identification."""

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import xxhash

from quarry.llm import common, fingerprints, language_id, mixing, sharding
from quarry.llm.queries import op2_language_id, op5_sharding, op6_mixing, op9_fingerprints

from conftest import SF_CHECK, SF_SMALL
import llm_fixtures as fx


def plain_anchors(text, k=fingerprints.K, s=fingerprints.S):
    """Closed syncmers by looking at each run on its own."""
    from quarry.llm.common import rolling, word_hashes
    ws = [w.encode() for w in fx.words(text)]
    out = []
    for i in range(len(ws) - k + 1):
        inner = rolling(word_hashes(ws[i:i + k]), s)
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, int(rolling(word_hashes(ws[i:i + k]), k)[0] >> 32)))
    return out


def test_anchors_depend_on_their_run_alone():
    text = fx.rows()[40][1] + " " + " ".join(f"w{i}" for i in range(300))
    at, h = fingerprints.anchors(text)
    assert list(zip(at.tolist(), h.tolist())) == plain_anchors(text)
    later, h2 = fingerprints.anchors("another start of it " + text)
    assert {(a + 4, x) for a, x in zip(at.tolist(), h.tolist())} <= set(zip(later.tolist(), h2.tolist()))
    back = fingerprints.from_text(fingerprints.as_text(at, h))
    assert back[0].tolist() == at.tolist() and back[1].tolist() == h.tolist()


def test_likeness():
    rng = random.Random(1)
    a = " ".join(f"w{rng.randrange(500)}" for _ in range(1000))
    b = " ".join(f"w{rng.randrange(500)}" for _ in range(1000))
    mark = fingerprints.anchors
    assert fingerprints.likeness(mark(a), mark(a)) == 1.0
    assert fingerprints.likeness(mark(a), mark(b)) < 0.02
    assert 0.4 < fingerprints.likeness(mark(a), mark(fingerprints.edited(a, b))) < 0.6
    assert fingerprints.likeness(mark(""), mark(None)) == 1.0
    assert fingerprints.likeness(mark(""), mark(a)) == 0.0


def test_short_texts():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    mark, alike = fingerprints.anchors, fingerprints.likeness
    for n in [*range(1, 41), 54, 107, 108, 109, 120]:
        apart, half = [], []
        for _ in range(20):
            a, b = (" ".join(rng.choice(vocab) for _ in range(n)) for _ in range(2))
            x = mark(a)
            assert fingerprints.as_text(*x) and alike(x, mark(a)) == 1.0 and alike(x, mark("")) == 0.0
            back = fingerprints.from_text(fingerprints.as_text(*x))
            assert [y.tolist() for y in back] == [y.tolist() for y in x]
            apart.append(alike(x, mark(b)))
            half.append(alike(x, mark(fingerprints.edited(a, b))))
            assert n < 3 or half[-1] > 0
        assert max(apart) < 0.5 and sum(apart) / 20 < 0.05, (n, apart)
        assert n < 4 or 0.25 < sum(half) / 20 < 0.65, (n, half)
    word, other = "internationalisation", "straightforwardness"
    assert 0 < alike(mark(word), mark(fingerprints.edited(word, other))) < 1 and alike(mark(word), mark(other)) == 0.0


M64 = (1 << 64) - 1


def plain_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def plain_hash(run):
    """A polynomial in the golden-ratio base, mixed."""
    x = 0
    for v in run:
        x = (x * 0x9E3779B97F4A7C15 + v) & M64
    return plain_mix(x)


def plain_syncmers(h, k, s):
    """Every run is looked at by itself."""
    if len(h) < k:
        return [(0, plain_mix((plain_hash(h) + len(h)) & M64) >> 32)]
    small = [plain_hash(h[i:i + s]) for i in range(len(h) - s + 1)]
    runs = [plain_hash(h[i:i + k]) for i in range(len(h) - k + 1)]
    out = [(i, r >> 32) for i, r in enumerate(runs) if min(small[i:i + k - s + 1]) in (small[i], small[i + k - s])]
    return out or [(runs.index(min(runs)), min(runs) >> 32)]


def plain_anchors(text):
    ws = fx.words(text)
    if not ws:
        return []
    out = plain_syncmers([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ws], 16, 4)
    if len(ws) < 4 * (2 * 16 - 4 - 1):
        out += [(i, v | 1 << 32) for i, v in plain_syncmers([plain_mix(ord(c) + 1) for c in " ".join(ws)], 4, 2)]
    return out


def plain_fingerprint(found):
    out, before = [], 0
    for at, h in found:
        out.append(f"{at - before:x}:{h:08x}")
        before = at
    return " ".join(out)


def plain_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    if a[-1][1] >> 32 or b[-1][1] >> 32:
        short = bool(a[-1][1] >> 32 and b[-1][1] >> 32)
        a, b = ([(at, h) for at, h in x if bool(h >> 32) == short] for x in (a, b))
    places = defaultdict(list)
    for at, h in b:
        places[h].append(at)
    met, shifts = Counter(), []
    for at, h in a:
        if met[h] < len(places[h]):
            shifts.append(places[h][met[h]] - at)
        met[h] += 1
    return max((sum(abs(x - y) <= 8 for y in shifts) for x in set(shifts)), default=0) / max(len(a), len(b))


def expected_pairs(data):
    data = sorted(((i, t or "") for i, t in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for (i, t), (_, following) in zip(data, data[1:] + data[:1]):
        half = len(t) // 2
        e = t[:len(t) - half] + following[:half]
        mine, changed = plain_anchors(t), plain_anchors(e)
        yield (i, len(t), fx.sha(e), plain_fingerprint(mine), plain_fingerprint(changed),
               plain_likeness(mine, changed), plain_likeness(mine, plain_anchors(following)))


def test_fingerprint_pairs(spark):
    got = fingerprints.fingerprint_pairs(fx.frame(spark)).collect()
    assert Counter(tuple(r) for r in got) == Counter(expected_pairs([r[:2] for r in fx.rows()]))
    assert fingerprints.fingerprint_pairs(fx.frame(spark).limit(0)).count() == 0
    one = fingerprints.fingerprint_pairs(spark.createDataFrame([(5, "abc def")], "doc_id long, text string")).collect()
    assert one[0].n_chars == 7 and one[0].near_next == 1.0


def test_fingerprints_query(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in op9_fingerprints(spark, SF_SMALL).collect()) == Counter(expected_pairs(data))


def check_shards(got, data, n=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(n)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding(spark, scratch):
    df = fx.frame(spark)
    out = sharding.write_shards(df, scratch("shards"), 8, bucket_bytes=20_000)
    assert set(out.columns) == set(df.columns)
    out = out.select("doc_id", sharding.text_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "shard", "slot")
    check_shards(out.collect(), [r[:2] for r in fx.rows()])
    assert sharding.write_shards(df.limit(0), scratch("none"), 8).count() == 0


def test_sharding_depends_on_nothing_else(spark, scratch):
    """Other shuffle partitions and another dealing of the input give the same places."""
    data = fx.rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for i, (n, parts) in enumerate(((3, 2), (20, 7))):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = spark.createDataFrame(data, fx.SCHEMA).repartition(parts)
        out = sharding.write_shards(df, scratch(f"place{i}"), 8, bucket_bytes=20_000).select("doc_id", "text", "shard", "slot")
        got.append(Counter(map(tuple, out.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_repeated_rows_spread_over_buckets(spark):
    """1,000 rows equal in every column, without an id: no bucket holds them all, and a bucket is a partition."""
    df = spark.createDataFrame([(None, "same text")] * 1000 + [(i, f"t{i}") for i in range(200)], "doc_id long, text string").repartition(4)
    out = sharding.scatter(df, sharding.text_size(), "doc_id", bucket_bytes=1000)
    many = {r["bucket"]: r["count"] for r in out.filter("rec.doc_id is null").groupBy("bucket").count().collect()}
    assert sum(many.values()) == 1000 and len(many) == 16 and max(many.values()) < 120
    at = out.select("bucket", F.spark_partition_id().alias("p")).distinct().collect()
    assert all(r.bucket == r.p for r in at)
    plan = sharding.shuffled(df, sharding.text_size(), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") + plan.count("ObjectHashAggregate") >= 1
    assert "Exchange hashpartitioning(bucket" not in plan


def test_sharding_query(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").collect()]
    got = op5_sharding(spark, SF_CHECK).collect()
    check_shards(got, data)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order) and sum(a + 1 == b for a, b in zip(order, order[1:])) < 20
    assert Counter(map(tuple, got)) == Counter(map(tuple, op5_sharding(spark, SF_CHECK).collect()))


def plain_targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, out, open_ = sum(sizes.values()), {}, dict(sizes)
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        if not full:
            out |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            out[s] = 3 * sizes[s]
            del open_[s]
    return out


def check_mix(got, data):
    size = Counter()
    for _, t, _, s, *_ in data:
        size[s] += len(fx.words(t))
    target = plain_targets(size)
    taken, count = Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + target[r.source])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
        count[r.source] += r.copies
    return taken, target, size


def test_mixing(spark):
    data = fx.rows()
    df = fx.frame(spark)
    got = mixing.copies(df, mixing.n_words()).selectExpr("doc.doc_id", "doc.source", "size", "source_size", "target", "copies",
                                                         "copies * size taken").collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(fx.words(r[1]))) for r in data)
    check_mix(got, data)
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in got for _ in range(r.copies))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_query(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = op6_mixing(spark, SF_CHECK).collect()
    taken, target, size = check_mix(got, data)
    for s in size:      # within one of the largest documents
        largest = max(r.size for r in got if r.source == s)
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + largest
    assert Counter(map(tuple, got)) == Counter(map(tuple, op6_mixing(spark, SF_CHECK).collect()))


def test_targets_capped(spark):
    for sizes in ({"a": 1, "b": 1000, "c": 5, None: 70}, {"a": 0, None: 0}, {"x": 10}, {"a": 1, "b": 1, "c": 1000, "d": 3, "é": 90}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        keyed = df.withColumn("source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")))
        got = {r.source: r.target for r in mixing.targets(keyed).collect()}
        for s, t in plain_targets(sizes).items():
            assert abs(got["t" if s is None else "s" + s] - t) < 1e-9 * (1 + t)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.train(docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1").withColumn("none", F.lit(None).cast("string"))
    got = language_id.identify(held.select("doc_id", "text", "lang", "none"), model, ["doc_id", "lang"], declared="none", host="none").collect()
    sure = [r for r in got if r.accepted]
    assert len(sure) >= 0.95 * len(got)
    assert sum(r.lang == r.lang_id for r in sure) >= 0.98 * len(sure)


def test_evidence_moves_short_texts(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    model = language_id.train(docs)
    rows = [(1, "en", "es", "h1.x.es", "es"), (2, "en", "fr", "h2.x.fr", "fr"), (9, "en", None, None, None),
            (10, "...", "de", "h.de", "de"), (11, None, "de", None, None)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    got = {r.id: r for r in language_id.identify(df, model, ["id"], suffix="suffix").collect()}
    assert len(got) == len(rows)
    assert (got[1].lang_id, got[2].lang_id) == ("es", "fr")
    assert not got[10].accepted and not got[11].accepted and got[10].lang_id == "und"


def test_host_prior_counts(spark):
    """Rows of a host that is mostly Spanish pull a doubtful one along."""
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    model = language_id.train(docs)
    for lang in ("es", "fr"):
        sure = docs.filter(F.col("lang") == lang).limit(30).selectExpr("doc_id id", "text", "'x.example' host")
        df = sure.union(spark.sql("select -1L id, 'en' text, 'x.example' host"))
        got = {r.id: r for r in language_id.identify(df, model, ["id"], declared=None).collect()}
        assert got[-1].lang_id == lang


def test_language_hostile(spark):
    df = fx.frame(spark)
    model = language_id.train(df)
    got = language_id.identify_documents(df, model, ["doc_id"]).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in fx.rows())
    by = {r.doc_id: r.accepted for r in got}
    assert not by[200] and not by[201] and not by[202] and not by[212]
    empty = language_id.train(df.limit(0))
    assert empty["langs"] == [] and language_id.identify_documents(df, empty, ["doc_id"]).count() == len(fx.rows())
    assert language_id.identify_documents(df.limit(0), model, ["doc_id"]).count() == 0


def test_language_query(spark):
    got = op2_language_id(spark, SF_SMALL).collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").count()
    assert sum(r.page_id is not None for r in got) == pages and {r.doc_id for r in got if r.doc_id is not None} == set(docs)
    right = [r.lang_id == docs[r.doc_id] for r in got if r.doc_id is not None and r.accepted]
    assert sum(right) >= 0.98 * len(right)


def test_null_hosts_are_dealt_out_and_judged(spark):
    """Rows without a host take the prior of all rows; no row is lost."""
    docs = common.documents(spark, SF_SMALL)
    model = language_id.train(docs)
    bare = docs.withColumn("source", F.lit(None).cast("string"))
    got = language_id.identify_documents(bare, model, ["doc_id"]).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert got.accepted.any()


def test_released_tables_go(spark):
    from quarry.session import path_exists
    kept, gone = common.cut(spark.range(10)), common.cut(spark.range(10).groupBy("id").count())
    assert gone.count() == 10 and path_exists(spark, gone._cut_path)
    assert spark.conf.get(common.CLEAN_SHUFFLES, None) is None
    common.release(gone)
    assert not path_exists(spark, gone._cut_path) and kept.count() == 10


def test_many_languages(spark):
    """More than 64 labels, each in letters of its own; the last has the fewest rows."""
    rng = random.Random(8)
    data = []
    for j in range(80):
        letters = [chr(0x4E00 + 12 * j + i) for i in range(12)]
        for _ in range(3 if j > 70 else 6):
            text = " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
            data.append((len(data), text, f"l{j:02}", "h"))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    model = language_id.train(df)
    assert model["langs"] == [f"l{j:02}" for j in range(80)]
    for declared in (None, "lang"):
        got = language_id.identify(df, model, ["doc_id", "lang"], declared=declared, host="source").collect()
        assert len(got) == len(data) and all(r.lang_id == r.lang and r.accepted for r in got)
