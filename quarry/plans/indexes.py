"""Named indexes over the driver's tables, built once and reused.

Each index lives below the shared folder (``spark.checkpoint.dir``) under a
name derived from the input's files (names, lengths, times) and the build
parameters, so repeated queries open it instead of rebuilding (the reference's
``create_*_index`` / ``load_*_index`` pair) and changed data get a new index.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from quarry.operators import index as ix
from quarry.session import path_exists, shared_dir, source_key
from quarry.sources import tables


def index_path(spark: SparkSession, sf_dir: str, kind: str) -> str:
    data = source_key(spark, tables.table_path(sf_dir, "documents"))
    h = hashlib.sha1(f"{data}|{kind}|v5".encode()).hexdigest()[:12]
    return f"{shared_dir(spark)}/quarry-index/{kind}-{h}"


def basic_index(spark: SparkSession, sf_dir: str) -> ix.Index:
    """A10: ``text`` indexed, ``docno`` and ``text`` stored."""
    path = index_path(spark, sf_dir, "basic")
    if ix.index_exists(spark, path):
        return ix.open_index(spark, path)
    return ix.build_index(tables.corpus(spark, sf_dir), path, fields=("text",), mode="overwrite")


def dense_index(spark: SparkSession, sf_dir: str):
    """``(docno, vec)`` of every document, by the hashed encoder."""
    from quarry.operators import dense
    path = index_path(spark, sf_dir, "dense")
    if not path_exists(spark, f"{path}/_meta"):
        docs = tables.corpus(spark, sf_dir)
        return dense.store_vectors(dense.document_vectors(basic_index(spark, sf_dir)), path, "overwrite", source=docs)
    return dense.open_dense_index(spark, path)


def keywords_index(spark: SparkSession, sf_dir: str) -> ix.Index:
    """Each document replaced by its keywords and synonyms."""
    from quarry.operators.keywords import expand_documents
    from quarry.sources.thesaurus import fixture
    path = index_path(spark, sf_dir, "keywords")
    if ix.index_exists(spark, path):
        return ix.open_index(spark, path)
    docs = expand_documents(tables.corpus(spark, sf_dir), fixture(spark), replace=True)
    return ix.build_index(docs, path, fields=("text",), mode="overwrite", store=False)


def two_fields_index(spark: SparkSession, sf_dir: str) -> ix.Index:
    """``text`` (field 0) and ``keywords`` (field 1)."""
    from quarry.operators.keywords import expand_documents
    from quarry.sources.thesaurus import fixture
    path = index_path(spark, sf_dir, "two_fields")
    if ix.index_exists(spark, path):
        return ix.open_index(spark, path)
    docs = expand_documents(tables.corpus(spark, sf_dir), fixture(spark), replace=False)
    return ix.build_index(docs, path, fields=("text", "keywords"), mode="overwrite", store=False)
