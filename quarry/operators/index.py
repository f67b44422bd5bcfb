"""The inverted index as a set of Parquet tables.

Layout (one folder per index)::

    docs/       docno, <fields...>                bucketed by docno
    forward/    docno, field, dl, terms           bucketed and sorted by docno
    postings/   docno, field, term, dl, tf, ntf   partitioned by term_bucket,
                                                  bucketed by docno, sorted by
                                                  term and ntf
    lexicon/    term, df, cf, impacts             partitioned by term_bucket
    _meta/      one JSON row: buckets, fields, counts (written last; its
                presence marks a complete index)

Why this layout scales:

* Documents are hash-bucketed by ``docno`` once (the only shuffle of the
  raw text).  Tokenising, counting term frequencies and writing the forward
  table and the postings then happen bucket-locally, with no further shuffle.
* At query time the per-(query, document) score sum needs no shuffle
  either (the scan is already clustered by ``docno``), and the per-query
  top-k runs a partial limit inside each bucket before the only shuffle,
  so at most buckets x queries x k rows cross the network - never the
  matched postings.
* ``term_bucket = pmod(xxhash64(term), T)`` partitions postings and lexicon;
  retrieval reads the partitions of its terms only.
* ``ntf = tf / (1 - b + b * dl / avgdl)`` is a posting's impact: every weighting
  model is an increasing function of it.  Files are sorted by term and impact,
  so Parquet's own statistics of row groups and pages are the largest and least
  impact of each block of a term's postings.
* The lexicon's ``impacts`` give, for each field, a term's largest impact and how
  many postings reach each step of a fixed ladder.  They are sums and maxima
  combined map-side, and give retrieval a lower bound of the k-th score before
  it reads any posting (``operators/retrieve.py``).
* The forward table gives a document's terms without any posting: relevance
  feedback reads the buckets of its few documents.

Term frequencies and lengths are stored raw beside the impact, so one index
serves every weighting model with any parameters.
Tables are registered in the session catalog under names derived from the
path, because Spark only keeps bucket information for catalog tables.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.stopwords import ENGLISH_STOP_WORDS
from quarry.functions.text import tokens
from quarry.operators.util import known_size, known_values, run_end, run_starts, stored
from quarry.session import path_exists, setting

DEFAULT_TERM_BUCKETS = 16
PUSHED_DOCS = 256       # up to so many document ids reach a scan as literals, which prune buckets
# b of the length normalisation in stored impacts.
B_LENGTH = 0.75
# Steps of the impact ladder of the lexicon.
LADDER = tuple(round(0.1 * 1.4 ** i, 6) for i in range(16))
# Input bytes per document bucket when the bucket count is derived from the
# size of the input (Catalyst's estimate of the scanned files).  A task sorts the
# postings of one bucket in memory: about 15 times these bytes (compressed text),
# so that four tasks fit into an executor of a few GB without spilling.
TARGET_BUCKET_BYTES = 16 * 1024 * 1024
# Off, a bucketed table is read by one task a bucket even where nothing needs it.
PACKED_BUCKETS = "spark.sql.sources.bucketing.autoBucketedScan.enabled"


def auto_doc_buckets(docs: DataFrame, target_bytes: int = TARGET_BUCKET_BYTES) -> int:
    """At least the session's default parallelism (its cores), more for
    large inputs: one bucket per ``target_bytes`` of input.  The input size
    is the sum of the file-backed leaf scans (each counted once).  An input
    without any (memory, checkpoints) is measured by one aggregate, as Spark's
    estimates for those can be far off.  Never more than Spark's own limit on
    buckets, with which the tables must be read, too.  Pass ``doc_buckets`` for an input that
    joins a large checkpoint with small files."""
    spark = docs.sparkSession
    floor = max(1, int(spark.sparkContext.defaultParallelism))
    it = docs._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    sizes = {}
    while it.hasNext():
        leaf = it.next()
        if leaf.getClass().getSimpleName() not in ("LogicalRelation", "HiveTableRelation",
                                                   "DataSourceV2Relation", "DataSourceV2ScanRelation"):
            continue
        key = leaf.simpleString(200).split("#")[0]
        sizes[key] = max(sizes.get(key, 0), int(str(leaf.stats().sizeInBytes())))
    size = sum(sizes.values()) if sizes else known_size(docs)[1]
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return int(min(most, max(floor, -(-size // target_bytes))))


def term_bucket(term_col, n_buckets: int):
    t = F.col(term_col) if isinstance(term_col, str) else term_col
    return F.pmod(F.xxhash64(t), F.lit(n_buckets)).cast("int")


def length_normalised(tf, dl, avgdl, b: float = B_LENGTH):
    """``tf / (1 - b + b * dl / avgdl)``."""
    return (F.col(tf) if isinstance(tf, str) else tf).cast("double") / (1.0 - b + b * F.col(dl).cast("double") / avgdl)


@dataclass(frozen=True)
class Index:
    """Handle on an opened index: DataFrames plus a few scalar statistics."""

    path: str
    docs: DataFrame
    postings: DataFrame
    lexicon: DataFrame
    forward: DataFrame
    doc_stats: DataFrame
    fields: tuple
    n_docs: int
    n_terms: int
    field_tokens: tuple          # total tokens per field, in field order
    doc_buckets: int
    term_buckets: int
    stop_words: tuple            # the list it was built with, () for none
    stemmed: bool
    max_docno_bytes: int
    max_term_bytes: int
    build_id: str                # new with every build

    def terms(self, c):
        """The index's own term rule (stop list, stemming) for any text column."""
        return tokens(c, self.stop_words or None, self.stemmed)

    @property
    def n_tokens(self) -> int:
        return int(sum(self.field_tokens))

    def avgdl(self, field: int = 0) -> float:
        return self.field_tokens[field] / self.n_docs if self.n_docs else 0.0

    def stats(self) -> DataFrame:
        """Documents, unique terms, tokens, average length (per field)."""
        spark = self.docs.sparkSession
        rows = [(i, f, self.n_docs, self.n_terms, int(t),
                 round(t / self.n_docs, 6) if self.n_docs else 0.0)
                for i, (f, t) in enumerate(zip(self.fields, self.field_tokens))]
        return spark.createDataFrame(
            rows, "field int, field_name string, n_docs long, n_terms long, "
                  "n_tokens long, avgdl double")


def _table_name(path: str, part: str) -> str:
    h = hashlib.sha1(path.encode()).hexdigest()[:12]
    return f"quarry_{h}_{part}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(p, True)


def index_exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/_meta")


def build_index(docs: DataFrame, path: str, fields=("text",), docno: str = "docno",
                doc_buckets: int | None = None, term_buckets: int = DEFAULT_TERM_BUCKETS,
                stop_words=ENGLISH_STOP_WORDS, mode: str = "errorifexists",
                stem: bool = False, store: bool = True) -> Index:
    """Index ``fields`` of ``docs`` (field i gets number i).

    ``store=False`` keeps no copy of the text (no ``get_text``), as for the
    keyword-only and two-field indexes.  ``doc_buckets`` defaults to ``auto_doc_buckets`` (one bucket per ~16 MB
    of input, at least the session's cores); ``term_buckets`` partitions
    postings and lexicon by term hash for partition pruning.

    ``mode``: ``errorifexists`` (the reference's create-or-fail),
    ``overwrite`` (the notebook's delete-and-rebuild) or ``ignore``
    (open the existing index; ``ValueError`` where it was built with other
    fields, stop list, stemming or stored text than asked for).  A15.
    """
    spark = docs.sparkSession
    fields = tuple(fields)
    if index_exists(spark, path) or path_exists(spark, path):
        if mode == "errorifexists":
            raise RuntimeError(f"there is an index at {path} already; pass mode='overwrite' to replace it")
        if mode == "ignore" and index_exists(spark, path):
            meta = _meta(spark, path)
            asked = {"fields": list(fields), "stop_words": list(stop_words or ()),
                     "stemmed": bool(stem), "stored": bool(store)}
            other = sorted(k for k, v in asked.items() if meta[k] != v)
            if other:
                raise ValueError(f"the index at {path} was built with other {', '.join(other)}")
            return open_index(spark, path)
        _delete(spark, path)
    for part in ("docs", "forward", "postings", "lexicon"):
        spark.sql(f"DROP TABLE IF EXISTS {_table_name(path, part)}")
    B = int(doc_buckets or auto_doc_buckets(docs))
    T = int(term_buckets)
    # 1. the one shuffle of raw text: hash documents into B buckets.  With
    #    ``store`` the bucketed text is kept (for text lookup) and tokenised
    #    from there; otherwise it is tokenised straight from the shuffle.
    hashed = docs.select(F.col(docno).alias("docno"), *[F.col(f) for f in fields]) \
        .repartition(B, "docno")
    if store:
        (hashed.write.mode("overwrite").format("parquet")
            .bucketBy(B, "docno").sortBy("docno")
            .option("path", f"{path}/docs").saveAsTable(_table_name(path, "docs")))
        src = spark.table(_table_name(path, "docs"))
    else:
        src = hashed

    # 2. bucket-local tokenising; a document's terms are sorted and counted in its
    #    array and never become rows here.  Empty fields keep a row of length 0.
    per_field = F.inline(F.array(*[
        F.struct(F.lit(i).alias("field"), tokens(F.col(f), stop_words, stem).alias("toks"))
        for i, f in enumerate(fields)]))
    (src.select("docno", per_field)
        .groupBy("docno", "field", F.size("toks").alias("dl"))
        .agg(F.sort_array(F.flatten(F.collect_list("toks"))).alias("toks"))
        .select("docno", "field", "dl", "toks", run_starts("toks").alias("at"))
        .select("docno", "field", "dl", F.transform("at", lambda s, j: F.struct(
            F.get("toks", s).alias("term"), (run_end("toks", "at", j) - s).cast("long").alias("tf"))).alias("terms"))
        .write.mode("overwrite").format("parquet")
        .bucketBy(B, "docno").sortBy("docno")
        .option("path", f"{path}/forward").saveAsTable(_table_name(path, "forward")))
    forward = spark.table(_table_name(path, "forward"))
    per_field_rows = {r["field"]: (r["n"], r["tok"], r["width"]) for r in
                      forward.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("tok"),
                                                   F.max(F.octet_length(F.col("docno").cast("string"))).alias("width"))
                      .collect()}
    n_docs = max((v[0] for v in per_field_rows.values()), default=0)
    field_tokens = [int(per_field_rows.get(i, (0, 0))[1] or 0) for i in range(len(fields))]

    # 3. postings with impacts, bucket-local: a task sorts those of one bucket, as
    #    files packed up to Spark's split size would spill that sort.
    avgdl = F.element_at(F.array(*[F.lit(t / n_docs if t else 1.0) for t in field_tokens]), F.col("field") + 1)
    postings = (forward.select("docno", "field", "dl", F.explode("terms").alias("t"))
                .select("docno", "field", F.col("t.term").alias("term"), "dl", F.col("t.tf").alias("tf"))
                .withColumn("ntf", length_normalised("tf", "dl", avgdl))
                .withColumn("term_bucket", term_bucket("term", T)))
    with setting(spark, PACKED_BUCKETS, "false"):
        (postings.write.mode("overwrite").format("parquet")
            .partitionBy("term_bucket").bucketBy(B, "docno").sortBy("term", "ntf")
            .option("path", f"{path}/postings").saveAsTable(_table_name(path, "postings")))
    post = spark.table(_table_name(path, "postings"))

    # 4. lexicon: fields of one document are added up bucket-locally, then one
    #    partial-aggregated shuffle by term, written from there (a term bucket has
    #    a file of each task, so no task holds a whole one).
    ntfs = [F.when(F.col("field") == i, F.col("ntf")).alias(f"ntf{i}") for i in range(len(fields))]
    terms = post.select("docno", "term_bucket", "term", "tf", *ntfs)
    if len(fields) > 1:
        terms = terms.groupBy("docno", "term_bucket", "term").agg(
            F.sum("tf").alias("tf"), *[F.max(f"ntf{i}").alias(f"ntf{i}") for i in range(len(fields))])
    reach = [F.count(F.when(F.col(f"ntf{i}") >= step, 1)).alias(f"r{i}_{j}")
             for i in range(len(fields)) for j, step in enumerate(LADDER)]
    impacts = F.array(*[F.struct(F.col(f"max{i}").alias("max"),
                                 F.array(*[F.col(f"r{i}_{j}") for j in range(len(LADDER))]).alias("reach"))
                        for i in range(len(fields))])
    (terms.groupBy("term_bucket", "term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"),
             *[F.max(f"ntf{i}").alias(f"max{i}") for i in range(len(fields))], *reach)
        .select("term", "df", "cf", impacts.alias("impacts"), "term_bucket")
        .sortWithinPartitions("term_bucket", "term")
        .write.mode("overwrite").format("parquet").partitionBy("term_bucket")
        .option("path", f"{path}/lexicon").saveAsTable(_table_name(path, "lexicon")))

    # 5. scalar statistics (a handful of rows) and the completion marker.
    n_terms, term_width = spark.table(_table_name(path, "lexicon")).agg(
        F.count(F.lit(1)), F.max(F.octet_length("term"))).first()
    meta = {
        "fields": list(fields),
        "docno_type": src.schema["docno"].dataType.simpleString(),
        "stored": bool(store),
        "doc_buckets": B,
        "term_buckets": T,
        "stop_words": list(stop_words or ()),
        "stemmed": bool(stem),
        "n_docs": int(n_docs),
        "n_terms": int(n_terms),
        "max_term_bytes": int(term_width or 0),
        "max_docno_bytes": max((int(v[2] or 0) for v in per_field_rows.values()), default=0),
        "build_id": uuid.uuid4().hex,
        "field_tokens": field_tokens,
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/_meta")
    return open_index(spark, path)


def _register(spark: SparkSession, path: str, part: str, ddl: str) -> str:
    name = _table_name(path, part)
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} {ddl} LOCATION '{path}/{part}'")
        if "PARTITIONED BY" in ddl:
            spark.sql(f"REPAIR TABLE {name}")
    return name


def _meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/_meta").first()[0])


def open_index(spark: SparkSession, path: str) -> Index:
    """Open a complete index or raise ``RuntimeError``."""
    if not index_exists(spark, path):
        raise RuntimeError(f"no complete index at {path}")
    meta = _meta(spark, path)
    B, fields = meta["doc_buckets"], tuple(meta["fields"])
    field_cols = ", ".join(f"`{f}` STRING" for f in fields)
    docno_type = meta["docno_type"]
    stored = meta["stored"]
    if stored:
        docs_t = _register(spark, path, "docs",
                           f"(docno {docno_type}, {field_cols}) USING parquet "
                           f"CLUSTERED BY (docno) SORTED BY (docno) INTO {B} BUCKETS")
    post_t = _register(spark, path, "postings",
                       f"(docno {docno_type}, field INT, term STRING, dl INT, tf BIGINT, ntf DOUBLE, "
                       f"term_bucket INT) USING parquet PARTITIONED BY (term_bucket) "
                       f"CLUSTERED BY (docno) SORTED BY (term, ntf) INTO {B} BUCKETS")
    lex_t = _register(spark, path, "lexicon",
                      "(term STRING, df BIGINT, cf BIGINT, "
                      "impacts ARRAY<STRUCT<max: DOUBLE, reach: ARRAY<BIGINT>>>, term_bucket INT) USING parquet "
                      "PARTITIONED BY (term_bucket)")
    fwd_t = _register(spark, path, "forward",
                      f"(docno {docno_type}, field INT, dl INT, terms ARRAY<STRUCT<term: STRING, tf: BIGINT>>) "
                      f"USING parquet CLUSTERED BY (docno) SORTED BY (docno) INTO {B} BUCKETS")
    forward = spark.table(fwd_t)
    doc_stats = forward.select("docno", "field", "dl")
    return Index(
        path=path,
        docs=spark.table(docs_t) if stored else doc_stats.select("docno").distinct(),
        postings=spark.table(post_t),
        lexicon=spark.table(lex_t),
        forward=forward,
        doc_stats=doc_stats,
        fields=fields,
        n_docs=meta["n_docs"],
        n_terms=meta["n_terms"],
        field_tokens=tuple(meta["field_tokens"]),
        doc_buckets=B,
        term_buckets=meta["term_buckets"],
        stop_words=tuple(meta["stop_words"]),
        stemmed=meta["stemmed"],
        max_docno_bytes=meta["max_docno_bytes"],
        max_term_bytes=meta["max_term_bytes"],
        build_id=meta["build_id"],
    )


def lexicon(index: Index) -> DataFrame:
    """Term -> document frequency, collection frequency."""
    return index.lexicon.select("term", "df", "cf")


def get_text(run: DataFrame, index: Index, field: str = "text") -> DataFrame:
    """Attach stored text to a run by ``docno`` (left join).

    The run (at most topics x depth rows) is written once, so the stages before
    it do not run again for each use.  For a few documents their ids go to the
    scan: it opens their buckets only, and files are sorted by ``docno``.
    Otherwise the docs table is joined as it is bucketed, by a sort-merge
    join that shuffles only the run (never the docs, which are never
    broadcast); the text work downstream (passages, scoring) then runs in
    as many tasks as there are buckets.
    """
    if field not in index.docs.columns:
        raise ValueError(f"index at {index.path} does not store field {field!r} (built with store=False)")
    docs = index.docs.select("docno", F.col(field).alias("text"))
    run = stored(run, "run")
    if known_size(run)[0] <= PUSHED_DOCS:
        docs = docs.filter(F.col("docno").isin(known_values(run, "docnos", F.col("docno"))))
        return run.join(docs, "docno", "left")
    return run.join(docs.hint("merge"), "docno", "left")
