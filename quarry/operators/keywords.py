"""RAKE keywords, thesaurus sense choice and expansion.

RAKE (Rose et al. 2010), per document:

* tokens are words (``[\\p{L}\\p{N}]+``, lower-cased) and punctuation runs;
  stop words and punctuation end a phrase;
* ``degree(w)`` adds the length of every phrase occurrence containing ``w``,
  ``freq(w)`` counts its occurrences; ``score(w) = degree / freq``;
* a phrase scores the sum of its word scores (rounded to 6 decimals);
  phrases are ranked by score desc, then phrase text desc, then position;
* keywords: walk ranked phrases word by word, skip repeats, keep the first
  ``max_keywords`` (default 3).

After one shuffle by document the work is document-local and scales with the
number of documents: Spark marks where phrases end, and an Arrow batch at a time
``_best_words`` scores the phrases of each document.

Sense choice (Lesk 1986) uses a thesaurus table
``(lemma, sense_id, gloss, members array<string>)``: among the keyword's
senses take the one whose gloss words (split on spaces) overlap most with
the distinct raw tokens of the text, ties by ``sense_id`` desc.  Its members
not equal to the keyword (case-insensitive) become synonyms, ``_`` -> space,
distinct, at most ``max_synonyms`` (default 2), in member order.  The
expansion of a text is each keyword followed by its synonyms.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.stopwords import ENGLISH_STOP_WORDS
from quarry.functions.text import WHITESPACE_CLASS
from quarry.operators.index import auto_doc_buckets
from quarry.operators.util import BROADCAST_MAX_BYTES, SCORE_DECIMALS, broadcast_if_small, known_size

MAX_KEYWORDS = 3
MAX_SYNONYMS = 2
METHODS = ("rake", "bert")
PART_DOCS = 20_000      # documents of a part that term vectors are learned from, on average
PART_BYTES = 8 << 20    # of input in a part of ``by_document``
SPLITS = 16             # of a term in the join with its vector, where that is no broadcast

_WORD = r"[\p{L}\p{N}]+"
_NOT_SPACE_OR_WORD = "[^\\p{L}\\p{N}" + WHITESPACE_CLASS[1:-1] + "]+"
RAKE_TOKEN = f"({_WORD}|{_NOT_SPACE_OR_WORD})"
_MARK = "\x01"      # ends a phrase; no word holds it


def by_document(docs: DataFrame, docno: str = "docno", text: str = "text") -> DataFrame:
    """``(docno, text)`` dealt by document.  Steps that start from the same
    frame share its one shuffle.  The work on a text is far more than its bytes
    tell, so the number of parts is not left to Spark's merging by bytes."""
    parts = auto_doc_buckets(docs, PART_BYTES)
    return docs.select(F.col(docno).alias("docno"), F.col(text).alias("text")).repartition(parts, "docno")


def _marked(text):
    """The lower-cased text with a mark for each run of punctuation."""
    # (a plain class: Java's regex recurses for every turn of a repeated group, and long runs end in a stack overflow)
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _NOT_SPACE_OR_WORD, f" {_MARK} ")


def _rounded(x: float) -> float:
    """As Spark rounds: half up, by the decimal form."""
    y = x * 10 ** SCORE_DECIMALS
    n = math.floor(y)
    if y > 1e11 or abs(y - n - 0.5) < 1e-3:
        return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-SCORE_DECIMALS), ROUND_HALF_UP))
    return (n + (y - n > 0.5)) / 10 ** SCORE_DECIMALS


def _best_words(texts, stop_words, most: int) -> list[str]:
    """The first ``most`` words of the ranked phrases of one document's marked
    texts.  Where an id has several texts, their n-th phrases count as one,
    its words by place, then by word."""
    degree, freq, phrases = {}, {}, []
    for t in texts:
        found, run = [], []
        for w in [*t.split(), _MARK]:
            if w != _MARK and w not in stop_words:
                run.append(w)
            elif run:
                found.append(run)
                run = []
        for run in found:
            n = len(run)
            for w in run:
                degree[w] = degree.get(w, 0) + n
                freq[w] = freq.get(w, 0) + 1
        if len(texts) == 1:
            phrases = found
            break
        for j, run in enumerate(found):
            if j == len(phrases):
                phrases.append([])
            phrases[j] += enumerate(run)
    if len(texts) > 1:
        phrases = [[w for _, w in sorted(placed)] for placed in phrases]
    weight = {w: n / freq[w] for w, n in degree.items()}
    by_score: dict[float, list[int]] = {}
    for j, ws in enumerate(phrases):
        score = 0.0
        for w in ws:
            score += weight[w]
        by_score.setdefault(_rounded(score), []).append(j)
    out: dict[str, None] = {}
    # falling score, then falling text, then the phrase that comes first (which has the same words)
    for score in sorted(by_score, reverse=True):
        if len(out) >= most:
            break
        for phrase in sorted({" ".join(phrases[j]) for j in by_score[score]}, reverse=True):
            out.update(dict.fromkeys(phrase.split(" ")))
    return list(out)[:most]


def rake_keywords(docs: DataFrame, docno: str = "docno", text: str = "text",
                  max_keywords: int = MAX_KEYWORDS,
                  stop_words=ENGLISH_STOP_WORDS, dealt: bool = False) -> DataFrame:
    """``(docno, kw_rank, keyword)``, at most ``max_keywords`` per document.

    Documents are shuffled by ``docno`` once, unless ``docs`` comes from
    ``by_document`` (``dealt``).  Words never become rows: a document's words are
    counted and its phrases ranked where it lies, so nothing spills."""
    d = docs if dealt else by_document(docs, docno, text)
    stops = frozenset(stop_words)

    @F.pandas_udf("array<string>")
    def best(texts: pd.Series) -> pd.Series:
        return texts.map(lambda ts: _best_words(ts, stops, max_keywords))

    ranked = _texts(d).select("docno", best(F.transform("texts", _marked)).alias("words"))
    # (the outer form: Spark would put a filter on the array below, and work it out twice)
    return (ranked.select("docno", F.posexplode_outer("words").alias("pos", "keyword"))
            .filter(F.col("keyword").isNotNull())
            .select("docno", (F.col("pos") + 1).alias("kw_rank"), "keyword"))


def _texts(d: DataFrame) -> DataFrame:
    """``(docno, texts)``: one row a document, also where an id repeats."""
    return d.groupBy("docno").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))


def keywords_extractor(docs: DataFrame, max_keywords: int = MAX_KEYWORDS, method: str = "rake",
                       docno: str = "docno", text: str = "text", term_vectors: DataFrame | None = None,
                       doc_vectors: DataFrame | None = None) -> DataFrame:
    """Dispatch on ``method``; ``ValueError`` for anything else."""
    if method not in METHODS:
        raise ValueError(f"unknown keyword method {method!r}; use one of {METHODS}")
    if method == "rake":
        return rake_keywords(docs, docno, text, max_keywords)
    if (term_vectors is None) != (doc_vectors is None):
        raise ValueError("method 'bert' needs both term_vectors and doc_vectors, or learns both")
    if term_vectors is None:
        term_vectors, doc_vectors = learned_vectors(docs, docno, text)
    return similarity_keywords(docs, term_vectors, doc_vectors, max_keywords, docno, text)


def learned_vectors(docs: DataFrame, docno: str = "docno", text: str = "text", dims: int = 32,
                    min_count: int = 5, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Vectors for G6, learned here: ``(term, vec)`` and ``(docno, vec)``.

    Word2Vec is fitted on all documents; terms seen less than ``min_count`` times
    have no vector.  Every document gets the mean of its terms' vectors.  Up to
    ``PART_DOCS`` documents are trained on in the order of their ids' hashes, so
    the same documents give the same vectors.  More are dealt into parts, each
    trained on by a task of its own, and Spark averages the parts; there a
    cluster may bring a part's documents in another order the next time, which
    moves the vectors a little.  Vocabulary and vectors pass through the driver
    (``dims`` floats a term), documents do not."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    from quarry.functions.text import tokens
    words = docs.select(F.col(docno).alias("docno"), tokens(F.col(text)).alias("words"))
    n = docs.count()
    parts = max(1, -(-n // PART_DOCS))
    learn = words if parts > 1 else words.orderBy(F.xxhash64("docno"), "docno").limit(max(n, 1))
    model = Word2Vec(vectorSize=dims, minCount=min_count, numPartitions=parts, maxIter=1, seed=seed,
                     inputCol="words", outputCol="vec").fit(learn.select("words"))
    terms = model.getVectors().select(F.col("word").alias("term"), vector_to_array("vector").alias("vec"))
    return terms, model.transform(words).select("docno", vector_to_array("vec").alias("vec"))


def similarity_keywords(docs: DataFrame, term_vectors: DataFrame, doc_vectors: DataFrame,
                        max_keywords: int = MAX_KEYWORDS, docno: str = "docno",
                        text: str = "text") -> DataFrame:
    """Single words (English stop words out) ranked by cosine similarity
    of their vector to the document vector, ties by term; top ``max_keywords``.

    ``term_vectors(term, vec array<double>)`` and ``doc_vectors(docno, vec)``
    come from ``learned_vectors`` or the caller's encoder; vectors are compared
    as given, and a vector of length 0 is like nothing (similarity 0).  Term
    vectors that are too large to broadcast are joined in ``SPLITS`` parts of
    each term, as a common term stands in nearly every document.
    """
    from quarry.functions.text import tokens
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))           # noqa: E731
    tv = term_vectors.select("term", F.col("vec").alias("tv"), norm(F.col("vec")).alias("tn"))
    dv = doc_vectors.select(F.col("docno"), F.col("vec").alias("dv"), norm(F.col("vec")).alias("dn"))
    # the document's vector meets its text, not each of its terms with their vectors: only terms and
    # similarities stay by document after that
    terms = (docs.select(F.col(docno).alias("docno"), F.col(text).alias("text")).join(dv, "docno")
             .select("docno", "dv", "dn", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")))
    if known_size(tv)[1] <= BROADCAST_MAX_BYTES:
        found = terms.join(F.broadcast(tv), "term")
    else:
        terms = terms.withColumn("part", F.pmod(F.xxhash64("docno"), F.lit(SPLITS)))
        tv = tv.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPLITS - 1).cast("long"))))
        found = terms.join(tv, ["term", "part"]).drop("part")
    dot = F.aggregate(F.zip_with("tv", "dv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = found.select(
        "docno", "term", F.round(F.coalesce(F.try_divide(dot, F.col("tn") * F.col("dn")), F.lit(0.0)), SCORE_DECIMALS).alias("sim"))
    return (scored.withColumn("kw_rank", F.row_number().over(
                W.partitionBy("docno").orderBy(F.col("sim").desc(), "term")))
            .filter(F.col("kw_rank") <= max_keywords)
            .select("docno", "kw_rank", F.col("term").alias("keyword")))


def thesaurus_expansion(docs: DataFrame, keywords: DataFrame, thesaurus: DataFrame,
                        max_synonyms: int = MAX_SYNONYMS, docno: str = "docno",
                        text: str = "text") -> DataFrame:
    """``(docno, kw_rank, keyword, synonyms array<string>)``.

    ``keywords`` is ``(docno, kw_rank, keyword)``; a keyword without a sense
    gets no synonyms.  The thesaurus is broadcast after a size check.
    """
    th = broadcast_if_small(thesaurus.select(F.lower("lemma").alias("lemma"), "sense_id",
                                             "gloss", "members"))
    texts = _texts(docs.select(F.col(docno).alias("docno"), F.col(text).alias("text")))
    ctx = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(RAKE_TOKEN), 1))       # noqa: E731
    gloss = F.split(F.trim(F.col("gloss")), WHITESPACE_CLASS + "+")
    # texts are joined as they are and read only where a keyword has a sense
    senses = (keywords.select("docno", "kw_rank", "keyword").join(th, F.lower("keyword") == F.col("lemma"), "left")
              .join(texts, "docno", "left")
              .select("docno", "kw_rank", "keyword", "sense_id", "members",
                      (F.col("lemma").isNotNull() & F.col("texts").isNotNull()).alias("found"),
                      F.when(F.col("lemma").isNotNull(), F.array_max(F.transform("texts", lambda t: F.size(
                          F.array_intersect(gloss, ctx(t)))))).alias("overlap")))
    synonyms = F.slice(F.array_distinct(F.transform(
        F.filter("members", lambda m: F.lower(m) != F.lower(F.col("keyword"))),
        lambda m: F.regexp_replace(m, "_", " "))), 1, max_synonyms)
    none = F.array().cast("array<string>")
    return (senses.withColumn("r", F.row_number().over(
                W.partitionBy("docno", "kw_rank", "keyword").orderBy(F.col("found").desc(), F.col("overlap").desc(),
                                                                    F.col("sense_id").desc())))
            .filter(F.col("r") == 1)
            .select("docno", "kw_rank", "keyword",
                    F.coalesce(F.when(F.col("found"), synonyms), none).alias("synonyms")))


def expansion_text(expanded: DataFrame) -> DataFrame:
    """Fold G8 rows into ``(docno, expansion)``: keyword, its synonyms, next
    keyword ... joined by spaces, in keyword order."""
    return (expanded.groupBy("docno")
            .agg(F.array_sort(F.collect_list(F.struct(
                "kw_rank", F.concat(F.array("keyword"), "synonyms").alias("ws")))).alias("k"))
            .select("docno", F.array_join(F.flatten(F.transform("k", lambda s: s["ws"])), " ")
                    .alias("expansion")))


def expand_texts(docs: DataFrame, thesaurus: DataFrame, docno: str = "docno",
                 text: str = "text", max_keywords: int = MAX_KEYWORDS,
                 max_synonyms: int = MAX_SYNONYMS) -> DataFrame:
    """G5 + G8 per text: ``(docno, text, expansion)``; texts without keywords
    get ``""``.  Keywords, senses and the texts themselves come from one scan
    and one shuffle of the documents."""
    # as a struct the id is never null, so joins put no filter of their own below the shared shuffle
    keyed = docs.select(F.struct(F.col(docno).alias("id")).alias("docno"), F.col(text).alias("text"))
    d = by_document(keyed)
    # Spark does not know that the Arrow call leaves rows where they lie: dealt as the texts are, these few
    # words a document meet them without another shuffle of the texts
    kw = rake_keywords(d, max_keywords=max_keywords, dealt=True).repartition(auto_doc_buckets(keyed, PART_BYTES), "docno")
    exp = expansion_text(thesaurus_expansion(d, kw, thesaurus, max_synonyms))
    return d.join(exp, "docno", "left") \
        .select("docno.id", "text", F.coalesce("expansion", F.lit("")).alias("expansion")) \
        .withColumnRenamed("id", "docno")


def expand_queries(topics: DataFrame, thesaurus: DataFrame, **kw) -> DataFrame:
    """G9 + B6: ``query = query + " " + expansion``, original kept as ``query_0``."""
    exp = expand_texts(topics, thesaurus, docno="qid", text="query", **kw) \
        .select(F.col("docno").alias("qid"), "expansion")
    return (topics.join(exp, "qid", "left")
            .withColumn("query_0", F.col("query"))
            .withColumn("query", F.concat_ws(" ", F.col("query"), F.coalesce("expansion", F.lit(""))))
            .drop("expansion"))


def expand_documents(docs: DataFrame, thesaurus: DataFrame, replace: bool = True,
                     docno: str = "docno", text: str = "text", **kw) -> DataFrame:
    """``replace=True`` - text becomes its expansion (keyword-only
    index, A11); otherwise a ``keywords`` column is added (two fields, A12)."""
    out = expand_texts(docs, thesaurus, docno=docno, text=text, **kw)
    if replace:
        return out.select("docno", F.col("expansion").alias("text"))
    return out.select("docno", "text", F.col("expansion").alias("keywords"))
