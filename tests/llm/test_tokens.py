import hashlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe, token_counts
from quarry.llm.queries import op1_token_counts, op10_bpe, tokenizer_json

from conftest import SF_SMALL
import llm_fixtures as fx


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_level():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_equal_library(spark, byte_level):
    got = token_counts.count_tokens(fx.frame(spark), tokenizer_json("byte_bpe_50k.json")).collect()
    want = [(i, len((t or "").encode()), len(byte_level.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in fx.rows()]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(want)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0 　'sdlvtre.,1aé<|endoftext|>"),
                                  st.characters(blacklist_categories=("Cs",)))))
def test_cut_text_counts_as_whole_text(text):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_cut_text_counts_as_whole_text, "tok") \
        else test_cut_text_counts_as_whole_text.tok
    test_cut_text_counts_as_whole_text.tok = tok
    import re
    special = re.compile(re.escape("<|endoftext|>"))
    lengths = token_counts._Lengths(tok, {})
    assert token_counts.text_tokens(text, lengths, special) == len(tok.encode(text, add_special_tokens=False).ids)


def test_empty_table(spark):
    empty = fx.frame(spark).limit(0)
    assert token_counts.count_tokens(empty, tokenizer_json("byte_bpe_50k.json")).count() == 0
    assert bpe.encode_decode(empty, tokenizer_json("word_bpe_49k.json")).count() == 0


def library(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


def test_bpe_equals_library(spark, word_level):
    got = bpe.encode_decode(fx.frame(spark), tokenizer_json("word_bpe_49k.json")).collect()
    want = [(i, *library(word_level, t)) for i, t, *_ in fx.rows()]
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in got) == \
        Counter((i, len(ids), tuple(ids), text) for i, ids, text in want)
    short = bpe.encode_decode(fx.frame(spark), tokenizer_json("word_bpe_49k.json"), digest=True).collect()
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in short) == \
        Counter((i, fx.sha(" ".join(map(str, ids))), fx.sha(text)) for i, ids, text in want)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x1c\x85\xa0 'sdlvtreÀÉȩ́ΣİK1½<|endoftext|>"),
                                  st.characters(blacklist_categories=("Cs",)))))
def test_words_encode_as_whole_text(text):
    self = test_words_encode_as_whole_text
    if not hasattr(self, "tok"):
        self.tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        self.special = bpe.special_strings(tokenizer_json("word_bpe_49k.json"))
    parts = [x for w in bpe.split_words(text, self.special) for x in self.tok.encode(w, add_special_tokens=False).ids]
    assert parts == self.tok.encode(text, add_special_tokens=False).ids


def test_all_characters_of_the_fast_range(word_level):
    special = bpe.special_strings(tokenizer_json("word_bpe_49k.json"))
    for c in map(chr, range(0x260)):
        for text in (c, f"a{c}b", f"1{c}2 {c}{c} '{c}S", f",{c};"):
            parts = [x for w in bpe.split_words(text, special) for x in word_level.encode(w, add_special_tokens=False).ids]
            assert parts == word_level.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_rules_are_refused():
    with pytest.raises(ValueError):
        bpe.check_rules(tokenizer_json("byte_bpe_50k.json"))


def test_decode_joins_pieces(spark, word_level):
    data = [(i, word_level.encode(t or "", add_special_tokens=False).ids) for i, (_, t, *_) in enumerate(fx.rows())]
    table = bpe.pieces(spark, tokenizer_json("word_bpe_49k.json"))
    got = bpe.decode(spark.createDataFrame(data, "k int, ids array<int>"), table, key="k").collect()
    assert {r.k: (r.ids, r.decoded) for r in got} == {i: (ids, word_level.decode(ids, skip_special_tokens=False)) for i, ids in data}


def test_queries_on_given_table(spark, byte_level, word_level):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = op1_token_counts(spark, SF_SMALL).collect()
    assert {(r.doc_id, r.n_tokens) for r in got} == {
        (i, len(byte_level.encode(t or "", add_special_tokens=False).ids)) for i, t in docs.items()}
    got = op10_bpe(spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids, text = library(word_level, docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), fx.sha(" ".join(map(str, ids))), fx.sha(text))


def test_listed_blocks_are_smaller(spark, monkeypatch):
    """Ids and texts that are returned stay in memory until their block's end: the pipeline's last stage went
    over its memory with blocks as large as a file part."""
    sizes, pack = [], bpe.pack_blocks

    def seen(docs, special, text, key, block_bytes):
        sizes.append(block_bytes)
        return pack(docs, special, text, key, block_bytes)
    monkeypatch.setattr(bpe, "pack_blocks", seen)
    monkeypatch.setattr(bpe, "LISTED_BYTES", 300)
    docs = spark.createDataFrame([(i, f"some words of text {i} " * (i % 9)) for i in range(60)], "doc_id long, text string")
    json_text = tokenizer_json("word_bpe_49k.json")
    listed = {r.doc_id: (r.n_tokens, r.decoded) for r in bpe.encode_decode(docs.coalesce(1), json_text).collect()}
    digest = {r.doc_id: r for r in bpe.encode_decode(docs.coalesce(1), json_text, digest=True).collect()}
    assert sizes == [300, bpe.BLOCK_BYTES] and len(listed) == 60
    for i, (n, decoded) in listed.items():
        assert n == digest[i].n_tokens and hashlib.sha256(decoded.encode()).hexdigest() == digest[i].decoded_sha256
