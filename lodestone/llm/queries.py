"""The queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, langid, spm, sql, toxicity, vecdedup, warc
from .common import new_path
from .minhash import near_duplicates
from .packing import pack
from .pii import find_pii
from .secrets import find_secrets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.training_text(docs))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "archive")
    warc.write(table(spark, sf_dir, "pages"), root)
    return warc.read(spark, root, strict=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_cross_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digests(spm.encode_documents(table(spark, sf_dir, "documents")))


def op9_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": sql.NEAR_DEDUP, "op5_warc": sql.WARC, "op10_embedding_near_dedup": sql.VECTOR_DEDUP}
