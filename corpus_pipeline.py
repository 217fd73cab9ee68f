"""A training-data pipeline over ``documents``: quality, line dedup, near-duplicates, mixing, packing.

Every stage works on all rows its predecessor kept; its result is written as Parquet and read again as the next
stage's documents. Stages whose result is documents return exactly the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import linededup, mixing, neardup, packing, quality
from parley.plans.shared import materialize

#: Words that a packing worker keeps encoded: two workers share an executor with a heap that the stages before have filled.
WORDS_HELD = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go.

    A null or empty text fails the base rules; null hosts are one host; equal rows go or stay together; an empty table
    stays empty; other columns go through.
    """
    return quality.kept_documents(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, short ones if many documents hold them; n_chars follows the text.

    The first copy is that of the smallest doc_id (nulls last). Rows equal in every column are one document and keep the
    same lines. Null and empty texts stay as they are, texts of any length are looked at whole, an empty table stays
    empty, other columns go through.
    """
    cleaned = linededup.without_copies(docs, rules=linededup.RUNS)
    new = F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.select(*[new.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose sets of 5-word shingles are alike to 0.8 or more stays.

    It is the one of the smallest doc_id (nulls last), then of a hash of the row; of equal rows one stays. Null and empty texts are one
    class; an empty table stays empty; other columns go through.
    """
    return neardup.one_of_each(docs, limit=neardup.LIMIT_NEAR, shingle=neardup.WORDS_NEAR, similarity=neardup.SIMILARITY)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeated rows, or none.

    Null sources are one source, the last in order; a row without a word is taken as often as its source as a whole;
    the order is that of a seeded hash of the row, and among equal rows of no account; an empty table stays empty; other
    columns go through.
    """
    return mixing.repeated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens.

    A null or empty text is the end id alone; equal rows are packed each; a long text is cut into pieces; an empty table
    gives no pieces; only doc_id and text are read.
    """
    return packing.pack(materialize(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), held=WORDS_HELD)))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express tokenizers and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
