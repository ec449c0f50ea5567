"""The corpus pipeline: language ID, near-duplicate removal, decontamination, PII redaction, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and gives what it keeps; ``run`` writes each stage's result as Parquet in the
shared folder and hands the next one what it reads back. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingoloom.llm import bpe, decontam, jaccard, langid, pii
from lingoloom.llm.common import staged

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Documents whose language is less certain are rejected. Low, so that short clean texts with a foreign line stay.
CERTAIN = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text or letters, and those of no certain language; a missing label is filled in."""
    found = langid.predict(docs, langid.fit(docs))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= CERTAIN))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays."""
    return jaccard.representatives(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    marked = decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.size("leaks") == 0).select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds tokens and n_tokens, and whether the tokens decode to the text again."""
    import public_tokenizers as tokenizers

    made = bpe.encode(docs, tokenizers.path(RANKS), tokenizers.PATTERN, outputs=("tokens", "n_tokens", "decoded_sha256"))
    return made.withColumn("exact", F.col("decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")), 256)).drop("decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontamination), ("pii", private_data), ("byte_bpe", tokens),
]

#: SQL can't express the trained and tokenizing stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
