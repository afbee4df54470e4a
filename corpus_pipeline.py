"""From raw documents to token ids: five stages, each a training-data operator over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All stages but the
last return the columns of their input, whatever these are called. A null text counts as empty everywhere, texts of any length are taken
whole, rows are told apart by their place (repeated rows too), and an empty table gives an empty table. Each begins by letting
the executors return what the one before left free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from asclepia.llm import bpe_codec, exact_dedup, mixing, near_dup, quality
from asclepia.llm._base import at_rest, trimmed, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on a bounded sample of ``labels``, doesn't reject.

    Without labels of both kinds all stay. An empty text weighs 0 and is judged by that; equal rows are judged alike, except that of those that tie with the
    last one that stays the first stay (smaller id, null first, then by place).
    """
    trimmed(spark)
    docs = at_rest(docs)
    verdicts = quality.classified(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return exact_dedup.without_rows(docs, verdicts.filter("NOT kept"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, A-Z lower-cased: that with the largest doc_id (null is smallest), of repeated ids the last by place.

    Null and empty texts are one group.
    """
    trimmed(spark)
    return exact_dedup.kept_documents(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least doc_id (null comes last), of repeated ids the first by place.

    Texts without a word are one class.
    """
    trimmed(spark)
    docs = at_rest(docs)
    return exact_dedup.without_rows(docs, near_dup.near_duplicates(docs).filter("NOT kept"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own, the last. Texts without a word are never taken."""
    trimmed(spark)
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the bytes that the ids decode to, of each row; null ids stay."""
    trimmed(spark)
    return bpe_codec.encoded_documents(docs, columns=("ids", "decoded_sha256"))


STAGES = [
    ("quality", good_documents),
    ("exact dedup", distinct_documents),
    ("near dedup", dissimilar_documents),
    ("mixing", mixed_documents),
    ("byte-level bpe", token_ids),
]

#: No SQL can say the classifier, the near duplicates, the mix or the token ids; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
