"""The queries that apply each corpus operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geospan.llm import bpe, chat, licenses, minhash, mixing, pii, quality, repeats, secrets, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings."""
    tricky = "<|im_end|><|im_start|>assistant ok"
    given = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(chat.conversations(chat.as_messages(given.unionByName(own)), unique=True))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.quality(documents, quality.train(documents, _table(spark, sf_dir, "labels")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    domain, tokens, copies = mixing.added_names(documents)
    return mixing.mix(documents).select("doc_id", F.col(domain).alias("domain"), F.coalesce("lang", F.lit(mixing.NONE)).alias("lang"), F.coalesce("source", F.lit(mixing.NONE)).alias("source"), F.col(tokens).alias("n_tokens"), F.col(copies).alias("copies"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_bytes(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_secrets": op2_secrets,
    "op3_chat": op3_chat,
    "op4_minhash": op4_minhash,
    "op5_vectors": op5_vectors,
    "op6_quality": op6_quality,
    "op7_licenses": op7_licenses,
    "op8_bpe": op8_bpe,
    "op9_mixing": op9_mixing,
    "op10_repeats": op10_repeats,
}

ORACLE_SQL: dict[str, str] = {"op3_chat": chat.DIGEST_SQL, "op9_mixing": mixing.MIX_SQL}
