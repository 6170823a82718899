"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import oracles
from loomfield.llm.ann import nearest_neighbours
from loomfield.llm.bpe import token_digests
from loomfield.llm.chat import render_conversations
from loomfield.llm.jaccard import similar_documents
from loomfield.llm.langid import predict_languages
from loomfield.llm.merkle import tamper_check
from loomfield.llm.negatives import hard_negatives
from loomfield.llm.packing import pack_documents
from loomfield.llm.reuse import word_token_digests
from loomfield.llm.secrets import scan_secrets
from loomfield.llm.tables import table
from loomfield.llm.topk import exact_top_k
from loomfield.llm.toxicity import with_toxicity
from loomfield.llm.url_filter import filter_urls

#: Url rules with their verdicts.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: Domains that the list blocks.
LISTED_DOMAINS = [
    "ads-track.example.com",
    "spam-farm.example.org",
    "casino-win.example.net",
    "adult-x.example.com",
    "cheap-pills.example.net",
    "free-bets.example.net",
]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_conversations(table(spark, sf_dir, "conversations"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(d,) for d in LISTED_DOMAINS], "key string")
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, listed)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = with_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "p_low_quality", "p_toxic", "is_toxic")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_check(table(spark, sf_dir, "documents"))


def op13_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_chat_formatting, op2_url_filters, op3_language_id, op4_exact_top_k, op5_ngram_jaccard, op6_nearest_neighbours, op7_byte_bpe,
        op8_packing, op9_toxicity, op10_secret_scans, op11_hard_negatives, op12_merkle_manifest, op13_chunk_bpe,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
