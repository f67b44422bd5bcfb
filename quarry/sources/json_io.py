"""JSON sources and sinks of the benchmark collection.

The reference's inputs are JSON *arrays* (one document per file).  A JSON
array cannot be split, so each file is one task, which reads it as a stream of
tokens, element by element, and never as one string.  This is the import path
only.  Everything we write is JSON lines (splittable, one object per line), and
the ``load_*`` readers accept both forms, so re-reading our own output is
parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quarry.session import file_heads, path_exists

S = T.StringType()

# The field names of the input files.
# Raw record of a train / validation / test split: all strings; query_id
# may be an int or a digit string in the source and is read as a string.
RECORD_SCHEMA = T.StructType([T.StructField(c, S) for c in (
    "para_id", "context", "raw_ocr", "publication_date",
    "query_id", "question", "answer", "org_answer")])
COLLECTION_FIELDS = ("para_id", "context", "raw_ocr", "publication_date")


def load_list_or_empty(spark: SparkSession, path: str,
                       schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """A5: records of JSON-array files as ``(pos, <schema fields>)``.

    Missing, zero-byte, invalid-JSON and non-list files give no rows instead
    of an error; ``pos`` is the position in the array (file order).
    """
    arrays = [f for f, head in file_heads(spark, path) if head.lstrip().startswith(b"[")]
    fields = T.StructType([T.StructField("pos", T.IntegerType())] + list(schema.fields))
    if not arrays:
        return spark.createDataFrame([], fields)
    rows = (spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(arrays)
            .withColumn("__file", F.input_file_name()).withColumn("__at", F.monotonically_increasing_id()))
    of_file = W.partitionBy("__file").orderBy("__at")       # a file's rows come from one task already
    return rows.withColumn("pos", F.row_number().over(of_file) - 1).select("pos", *[F.col(f"`{f.name}`") for f in schema.fields])


def _holds_array(spark: SparkSession, path: str) -> bool:
    check_paths(spark, path)  # A4
    head = next((head for _, head in file_heads(spark, path) if head.strip()), b"")
    return head.lstrip().startswith(b"[")


def _read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON array or JSON lines, whichever the file holds."""
    if _holds_array(spark, path):
        return load_list_or_empty(spark, path, schema).drop("pos")
    return spark.read.schema(schema).json(path)


def check_paths(spark: SparkSession, *paths: str) -> None:
    """A4: ``FileNotFoundError`` for the first missing input."""
    for p in paths:
        if not path_exists(spark, p):
            raise FileNotFoundError(f"nothing to read at {p}")


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """A1: collection file -> corpus ``(docno, text)``; other fields dropped."""
    schema = T.StructType([T.StructField(c, S) for c in COLLECTION_FIELDS])
    return _read_records(spark, path, schema).select(
        F.col("para_id").alias("docno"), F.col("context").alias("text"))


def load_queries(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A2: topics file -> ``(qid, query, ...)``; other columns kept (those of
    ``schema``, or all that the file has, values as strings)."""
    if schema is None:
        as_array = _holds_array(spark, path)
        found = spark.read.option("primitivesAsString", True).option("multiLine", as_array).json(path)
        schema = T.StructType([f for f in found.schema.fields if f.name not in ("query_id", "question")])
        schema = T.StructType([T.StructField("query_id", S), T.StructField("question", S), *schema.fields])
    return _read_records(spark, path, schema).withColumnsRenamed(
        {"query_id": "qid", "question": "query"})


QRELS_SCHEMA = T.StructType([T.StructField("query_id", S), T.StructField("iteration", T.IntegerType()),
                             T.StructField("para_id", S), T.StructField("relevance", T.IntegerType())])


def load_qrels(spark: SparkSession, path: str) -> DataFrame:
    """A3: judgments file -> ``(qid, iteration, docno, relevance)``."""
    return _read_records(spark, path, QRELS_SCHEMA).select(
        F.col("query_id").alias("qid"), "iteration", F.col("para_id").alias("docno"), "relevance")


def preview(spark: SparkSession, path: str, chars: int = 500) -> DataFrame:
    """Per file - first ``chars`` characters, top-level kind (list /
    dict / other), item count, keys and text of the first item."""
    v = F.col("value")
    kind = (F.when(F.ltrim(v).startswith("["), "list")
             .when(F.ltrim(v).startswith("{"), "dict").otherwise("other"))
    items = F.from_json(v, T.ArrayType(S))
    first = F.when(kind == "list", F.get(items, 0))
    return (spark.read.text(path, wholetext=True)
            .select(F.input_file_name().alias("path"), F.substring(v, 1, chars).alias("head"),
                    kind.alias("kind"),
                    F.when(kind == "list", F.size(items)).alias("n_items"),
                    F.json_object_keys(F.when(kind == "list", first)
                                       .when(kind == "dict", v)).alias("keys"),
                    F.substring(first, 1, 600).alias("first_item")))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 JSON lines, one shard per partition (not one indented array)."""
    df.write.mode(mode).json(path)
