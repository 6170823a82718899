"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of documents. A stage's result is
written as Parquet and read again before the next one. Columns that documents
have beside their own are kept, whatever their names; an empty table passes all
stages and gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.jaccard import without_near_duplicates
from loomfield.llm.langid import UNKNOWN, with_languages
from loomfield.llm.packing import pack_documents
from loomfield.llm.secrets import redact_secrets
from loomfield.llm.tables import materialise, table
from loomfield.llm.toxicity import with_toxicity

#: A text whose n-grams lie farther from every language than this is in none of them.
LEAST_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without letters, or far from every profile, go.

    A null or empty text has no letters and goes; repeated rows, and rows without
    doc_id, are judged each; a long text is judged whole; where nothing can be
    learned, as without lang, every document goes.
    """
    judged = with_languages(docs)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not find toxic.

    A null or empty text is judged by the models' constants; repeated rows, and
    rows without doc_id, are judged each; without labels all documents stay.
    """
    return with_toxicity(docs, table(spark, sf_dir, "labels")).where("NOT is_toxic").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id.

    Where that doc_id stands on several texts, the text with the smallest hash
    stays; rows that repeat doc_id and text are one; rows without doc_id, and
    documents without words, stay.
    """
    return without_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked; a null text stays null, repeated rows are masked each."""
    return redact_secrets(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text gives one piece, the id that ends it."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("ngram_jaccard", near_duplicates),
    ("secret_scans", secrets),
    ("packing", packing),
]
#: Models, automata and packing by dynamic programming have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
