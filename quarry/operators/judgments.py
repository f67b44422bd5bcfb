"""Relevance judgments derived by text containment.

The driver's tables carry no judgments; the stand-in is "document d is
relevant to passage q when d's text contains q's text" (see FIXTURES.md).
A nested-loop ``contains`` join would compare every passage with every
document.  Instead:

1. each passage of 3 tokens or more is keyed by the hash of an interior token
   window (tokens 2 .. 1+L, L = min(width, n - 2)): interior tokens of a
   contained passage are whole tokens of the document, in the same order;
   a shorter passage has no interior token and is keyed by the hash of its
   first L = min(12, length) characters;
2. each document emits the distinct hashes of its windows of those lengths, in
   tokens (usually just ``width``) and, only if a short passage needs it, in
   characters: one pass over the documents, probing the passage keys - a
   map-side equi-join where they are small;
3. the few candidate pairs are verified with ``contains`` on the raw text.

Candidates are a superset of the true pairs, so the result is exact.  An empty
passage is contained in every text; null texts and passages match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.util import broadcast_if_small
from quarry.session import temporary_path

SHINGLE_WIDTH = 8
GRAM_WIDTH = 12


def _hashes(toks):
    """Each token is hashed once, not once for every window it stands in."""
    return F.transform(toks, lambda t: F.xxhash64(t))


def _token_run(hashes, at, L, width):
    """Hash of ``L`` token hashes from index ``at`` (0-based).  Elements are
    read in place: ``slice`` would copy the whole array for every window.
    Beyond ``L`` they are null, which the hash leaves out."""
    return F.xxhash64(*[F.when(F.lit(j) < L, F.get(hashes, at + j)) for j in range(width)])


def _key(parts, L, piece):
    """Key of a window from the hash of its content; the kind of its parts and
    their number belong to it."""
    return F.xxhash64(parts, L, piece)


def _token_windows(hashes, L: int):
    n = F.size(hashes)
    return F.when(n >= L, F.transform(F.sequence(F.lit(1), n - L + 1), lambda i: _key(
        F.lit("token"), F.lit(L), _token_run(hashes, i - 1, F.lit(L), L))))


def _char_windows(text, L: int):
    """All runs of ``L`` characters in one pass of a regular expression:
    ``substr`` would count characters from the start for every window."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{L}}}))"), F.lit(1)),
                       lambda g: _key(F.lit("char"), F.lit(L), F.xxhash64(g)))


def containment_qrels(docs: DataFrame, passages: DataFrame, width: int = SHINGLE_WIDTH,
                      docno: str = "docno", qid: str = "qid", text: str = "text",
                      passage_text: str = "text") -> DataFrame:
    """``(qid, docno, iteration=0, relevance=1)`` for every document whose
    text contains the passage text."""
    ptext = F.col("ptext")
    p = (passages.select(F.col(qid).alias("qid"), F.col(passage_text).alias("ptext"))
         .filter(ptext.isNotNull())
         .withColumn("toks", tokens(ptext, stop_words=None))
         .withColumn("parts", F.when(F.size("toks") >= 3, "token").otherwise("char"))
         .withColumn("L", F.when(F.col("parts") == "token", F.least(F.lit(width), F.size("toks") - 2))
                     .otherwise(F.least(F.lit(GRAM_WIDTH), F.char_length(ptext))))
         .withColumn("hashes", _hashes(F.col("toks")))
         .select("qid", "ptext", "parts", "L", _key(
             F.col("parts"), F.col("L"),
             F.when(F.col("parts") == "token", _token_run(F.col("hashes"), F.lit(1), F.col("L"), width))
             .otherwise(F.xxhash64(ptext.substr(F.lit(1), F.col("L"))))).alias("key")))
    needed = sorted((r[0], r[1]) for r in p.select("parts", "L").distinct().collect())  # <= 8 + 13 rows
    if not needed:
        return passages.sparkSession.createDataFrame(
            [], f"qid {passages.schema[qid].dataType.simpleString()}, "
                f"docno {docs.schema[docno].dataType.simpleString()}, iteration int, relevance int")
    texts = docs.select(F.col(docno).alias("docno"), F.col(text).alias("dtext"))
    hashes, dtext = F.col("hashes"), F.col("dtext")
    d = texts.filter(dtext.isNotNull())
    if any(parts == "token" for parts, _ in needed):
        d = d.withColumn("hashes", _hashes(tokens(dtext, stop_words=None)))
    windows = [_token_windows(hashes, L) if parts == "token" else _char_windows(dtext, L) for parts, L in needed]
    # repeated windows of a document meet their passage again: the pairs are made distinct, which is
    # linear in the windows of a document however long it is
    # (the outer form, as Spark puts a filter on an exploded array below its projection and would
    # hash all tokens again for every window)
    none = F.array().cast("array<bigint>")
    keyed = d.select("docno", F.explode_outer(F.concat(*[F.coalesce(w, none) for w in windows])).alias("key"))
    cand = keyed.join(broadcast_if_small(p.select("qid", "key")), "key").select("qid", "docno").distinct()
    # the candidates are written once to the shared folder, so the size check
    # of their broadcast does not scan the documents again
    path = temporary_path(docs.sparkSession, "candidates")
    cand.write.parquet(path)
    cand = broadcast_if_small(docs.sparkSession.read.schema(cand.schema).parquet(path))
    verified = (texts.join(cand, "docno")
                .join(broadcast_if_small(p.select("qid", "ptext")), "qid")
                .filter(dtext.contains(ptext)))
    return verified.select("qid", "docno", F.lit(0).alias("iteration"), F.lit(1).alias("relevance"))
