"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import temporary_path

from . import (bpe, chat, common, embedding_dedup, fingerprints, jaccard_join, language_id, merkle, mixing, oracle, sharding,
               substring_dedup, token_counts, topk_search, whitening)

SHARDS = 8


def tokenizer_json(name: str) -> str:
    """Content of a public tokenizer's file; shipped to the executors."""
    import public_tokenizers
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(common.documents(spark, sf_dir), tokenizer_json("byte_bpe_50k.json"))


def op2_language_id(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    model = language_id.train(docs)
    of_docs = language_id.identify_documents(docs, model, ["doc_id"])
    of_pages = language_id.identify_pages(_table(spark, sf_dir, "pages"), model)
    return of_docs.withColumn("page_id", F.lit(None).cast("long")).unionByName(
        of_pages.withColumn("doc_id", F.lit(None).cast("long")))


def op3_chat_format(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                 "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(chat.text_parts(rows.unionByName(more))))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(common.documents(spark, sf_dir)).drop("rid")


def op5_sharding(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    shards = sharding.write_shards(docs, temporary_path(spark, "shards"), SHARDS)
    text = F.coalesce("text", F.lit(""))
    return shards.select("doc_id", sharding.text_size().alias("size"), F.crc32(text).alias("text_crc32"),
                         F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", "source", mixing.n_words().alias("n"))
    drawn = mixing.copies(docs, F.col("n"))
    return drawn.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "doc.source", "copies")


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(common.documents(spark, sf_dir), digest=True)


def op8_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_pairs(common.documents(spark, sf_dir))


def op10_bpe(spark, sf_dir):
    return bpe.encode_decode(common.documents(spark, sf_dir), tokenizer_json("word_bpe_49k.json"), digest=True)


def op11_topk_search(spark, sf_dir):
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op12_merkle(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(common.documents(spark, sf_dir), tampered).drop("copied")


def op13_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_language_id, op3_chat_format, op4_jaccard_join, op5_sharding, op6_mixing,
    op7_substring_dedup, op8_embedding_dedup, op9_fingerprints, op10_bpe, op11_topk_search,
    op12_merkle, op13_whitening)}

ORACLE_SQL = oracle.SQL
