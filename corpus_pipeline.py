"""A pipeline that prepares ``documents`` for training: each stage works on all that the one before it kept.

Quality rules drop documents, near-duplicates are reduced to one of each group,
secrets are blotted out of the texts, sources are mixed to their weights, and
what is left is encoded.

Every stage takes an empty table, and any extra columns: it leaves them as they
are. What else it makes of odd rows is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geospan.llm import bpe, minhash, mixing, quality, secrets
from geospan.llm.common import checkpointed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and consist of content; the field is fitted on the labelled ones.

    Null and empty texts have no words and go; repeated rows stay or go together;
    null ids count like others. Without labels the prior field judges.
    """
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates (five words, similarity 0.8 or more).

    Texts without words are near-duplicates of nothing; repeated rows become one;
    of rows that share an id but not the text, one stays; rows without an id stay.
    """
    return minhash.keep_one(docs, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; null and empty texts, null ids and repeated rows stay as they are."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document is repeated for each epoch that takes it.

    Null languages and sources are leaves of their own; rows without text have no
    tokens and come with the prefix that they fall in; repeated rows count each.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to: one row for each row, no ids for null or empty text."""
    return bpe.encode_and_check(docs)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("secret scan", secret_scan), ("mixing", mix_sources), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs


#: The fitted field and the transducer have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None
