from collections import Counter

import corpus_pipeline as cp
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import mixing

from conftest import SF_SMALL
import llm_fixtures as fx


def plain(data, k, percent, w):
    """Near-duplicate and passage stages by brute force, on (id, text) rows."""
    comps = fx.jaccard_components(data, k, percent)
    kept = [r for r, (i, n, c) in zip(data, comps) if not n or i == c]
    return kept, {i: (kept_text if gone else None) for i, _, gone, kept_text in fx.removed(kept, w)}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixing", "bpe"]
    first = cp.language(spark, docs, SF_SMALL).cache()
    assert first.columns == docs.columns
    assert 0.9 * docs.count() <= first.count() <= docs.count()
    rows = [tuple(r) for r in first.select("doc_id", "text").orderBy("doc_id").collect()]
    assert set(rows) <= {tuple(r) for r in docs.select("doc_id", "text").collect()}

    kept, cleaned = plain(rows, 5, 80, 35)
    second = cp.near_duplicates(spark, first, SF_SMALL).cache()
    assert second.columns == docs.columns and {tuple(r) for r in second.select("doc_id", "text").collect()} == set(kept)

    third = cp.repeated_passages(spark, second, SF_SMALL).cache()
    assert third.columns == docs.columns
    want = {i: t if cleaned[i] is None else cleaned[i] for i, t in kept}
    assert {r.doc_id: r.text for r in third.collect()} == want

    fourth = cp.mixed(spark, third, SF_SMALL).cache()
    drawn = mixing.copies(third, mixing.n_words()).selectExpr("doc.doc_id", "copies").collect()
    assert Counter(r.doc_id for r in fourth.collect()) == Counter(r.doc_id for r in drawn for _ in range(r.copies))

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = Counter((r.doc_id, tuple(r.ids)) for r in cp.coded(spark, fourth, SF_SMALL).collect())
    assert got == Counter((r.doc_id, tuple(tok.encode(r.text, add_special_tokens=False).ids)) for r in fourth.collect())


def test_run(spark):
    assert cp.run(spark, SF_SMALL).count() > 0


def test_hostile_rows(spark):
    docs = fx.frame(spark)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
        docs = out.cache()
        assert docs.count() > 0, name
    assert cp.coded(spark, docs, "").count() == docs.count()


def test_rejected_documents_go(spark):
    docs = fx.frame(spark)
    left = {r.doc_id for r in cp.language(spark, docs, "").collect()}
    assert not left & {200, 201, 202, 212} and len(left) > 80


def test_one_of_each_group_stays(spark):
    data = [(None, "a b c d e f g", "en", "a", 1), (None, "a b c d e f g", "en", "a", 1), (3, "a b c d e f g", "en", "a", 1),
            (2, "A b c d e f g", "en", "a", 1), (5, None, "en", "a", 1), (6, "", "en", "a", 1)]
    got = cp.near_duplicates(spark, fx.frame(spark, data=data), "").collect()
    assert sorted(r.doc_id for r in got) == [2, 5, 6]


def test_clean_text_is_unchanged(spark):
    data = [(1, "a  b\n" * 3, "en", "a", 1), (2, None, "en", "a", None)]
    got = {r.doc_id: r.text for r in cp.repeated_passages(spark, fx.frame(spark, data=data), "").collect()}
    assert got == {1: "a  b\n" * 3, 2: None}
