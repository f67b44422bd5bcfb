import numpy as np

from quarry.llm import embedding_dedup
from quarry.llm.queries import op8_embedding_dedup

from conftest import SF_CHECK


def brute(ids, x, cosine=0.95):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x]
    n = len(ids)
    links = [set() for _ in ids]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(x[i]) == len(x[j]):
                a, b = np.array(x[i], float), np.array(x[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    return links


def components(ids, links):
    out = {}
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = min(ids[j] for j in seen)
    return out


def test_hostile_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    x = [v.tolist() for v in base] + [(v + 0.02 * rng.standard_normal(16)).tolist() for v in base[:20]] + [base[0].tolist()] * 30
    x += [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [2.0, -1.0], [2.0], [3.0], [-1.0], [0.5] * 7]
    short = rng.standard_normal((9, 5))
    x += [v.tolist() for v in short] + [(v * 2 + 0.01).tolist() for v in short[:4]] + [short[0].tolist()] * 3
    ids = list(range(len(x)))
    df = spark.createDataFrame(list(zip(ids, x)), "vec_id long, embedding array<float>").selectExpr("*", "7 label", "1 cid", "2 v").repartition(4)
    single = [None if v is None else [None if c is None else float(np.float32(c)) for c in v] for v in x]
    links = brute(ids, single)
    comp = components(ids, links)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    assert len(got) == len(ids)
    for i in ids:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), comp[i], comp[i] == i)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
    assert [r.n_links for r in embedding_dedup.near_vectors(df.limit(1)).collect()] == [0]


def test_recall_on_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows)).collect()}
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95).sum(1) - 1
    found = np.array([got[r.vec_id].n_links for r in rows])
    assert (found <= near).all() and found.sum() >= 0.9 * near.sum()


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is hardly above the threshold."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((1500, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.953 * a + np.sqrt(1 - 0.953 ** 2) * o
    x = np.concatenate([a, b])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df).collect()}
    assert sum(got[i] for i in range(1500)) >= 0.9 * 1500


def at_the_threshold(m, mean, seed, dim=64):
    """``m`` unit vectors whose mean has the given norm, and partners at cosine 0.953."""
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((m, dim))
    a[:, 0] = 0
    a *= np.sqrt(1 - mean ** 2) / np.linalg.norm(a, axis=1, keepdims=True)
    a[:, 0] = mean
    o = rng.standard_normal((m, dim))
    o -= (o * a).sum(1, keepdims=True) * a
    return a, 0.953 * a + np.sqrt(1 - 0.953 ** 2) * o / np.linalg.norm(o, axis=1, keepdims=True)


def test_recall_of_long_substrings():
    """Substrings as on tables of 1M to 16M rows; pairs outside the sample."""
    for mean, sub in ((0, 20), (0, 22), (0, 24), (0.5, 20), (0.5, 24), (0.8, 20)):
        plan = embedding_dedup.fit(at_the_threshold(8192, mean, 1)[0], 1 << sub, sub=sub)
        a, b = (plan.codes(x) for x in at_the_threshold(2000, mean, 2))
        apart = sum(np.bitwise_count(x ^ y) for x, y in zip(a[:2], b[:2]))
        found = (plan.cells(a) == plan.cells(b)).any(axis=1) & (apart <= plan.far)
        assert plan.sub == sub and found.mean() >= 0.9


def test_recall_with_a_common_mean(spark):
    for mean, sub in ((0, 20), (0.8, None)):
        a, b = at_the_threshold(1000, mean, 3)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df, sub=sub).collect()}
        assert sum(got[i] > 0 for i in range(1000)) >= 0.9 * 1000


def test_query(spark):
    got = op8_embedding_dedup(spark, SF_CHECK).collect()
    rows = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").collect()
    assert {r.vec_id for r in got} == {r.vec_id for r in rows}


def test_workers_without_the_package(tmp_path):
    """Executors need no copy of the library: workers are started where they cannot import it."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {str(tmp_path / "ckpt")!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate())
from quarry.llm import embedding_dedup, merkle, topk_search, whitening
from pyspark.sql import functions as F
df = spark.createDataFrame([(i, [float(i % 5), 1.0, 2.0]) for i in range(20)], "vec_id long, embedding array<double>")
print("LINKS", sorted(r.n_links for r in embedding_dedup.near_vectors(df).collect())[-1])
print("TOP", topk_search.top_k(df, F.col("id") == 0).count(), "WHITE", whitening.whiten(df).count())
docs = spark.createDataFrame([(i, "T", "en", "a", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
print("VERIFIED", merkle.manifest(docs).filter("verified").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "TOP 5 WHITE 60" in done.stdout and "VERIFIED 20" in done.stdout and "LINKS" in done.stdout
