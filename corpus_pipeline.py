"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next
stage starts; a stage therefore first deletes the intermediate tables of the stages before it,
and of nothing else. Empty tables, null columns and extra columns pass through all stages but the
last unchanged.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, toxicity
from lodestone.llm.common import Scratch, staged
from lodestone.llm.minhash import drop_copies
from lodestone.llm.packing import pack
from lodestone.llm.secrets import redact_secrets


#: The intermediate tables of the stage that runs, and what it still reads of earlier ones.
SCRATCH = Scratch()


def stage(fn):
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        SCRATCH.clear(spark, docs)
        with SCRATCH:
            return fn(spark, docs, sf_dir)

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the rejection threshold."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@stage
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determinable language."""
    return langid.keep_determined(docs, langid.training_text(docs))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of smallest doc_id, and of smallest text
    among several of that id, once. Documents without words, and of null ids, stay."""
    return drop_copies(docs)


@stage
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; n_chars follows the text."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [("toxicity", drop_toxic), ("language_id", keep_languages), ("minhash_near_dedup", drop_near_duplicates), ("secret_scan", redact), ("best_fit_packing", pack_sequences)]

#: Learned models decide in the first two stages, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = step(spark, docs, sf_dir)
        with SCRATCH:
            docs = staged(docs, name)
    out = STAGES[-1][1](spark, docs, sf_dir)
    SCRATCH.clear(spark, out)
    SCRATCH.paths.clear()  # what the result reads lasts as long as the session
    return out
