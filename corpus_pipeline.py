"""Training-corpus pipeline: five stages from ``documents`` to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. Results
are written as Parquet to the shared folder and read again, so a lost executor never costs more
than the stage that runs.

Defined cases, for every stage but the last: the columns of its input come out unchanged (extra ones,
nulls and names that an operator also uses), but for ``text`` and ``n_chars`` after ``suffix_dedup``; an
empty table gives an empty one; repeated rows are copies of each other, of which one stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, minhash, mixing, rules, suffix
from lodestone.llm.common import Workspace


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no quality rule rejects; null, empty and very short texts go."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_lodestone_row")
    judged = rules.quality_rules(docs.select(row, F.col("text").alias("_text")), text="_text", verdict_only=True)
    return judged.filter("kept").select("_lodestone_row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of near copies: the least doc_id; texts without words match equal texts only."""
    return minhash.keep_one(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur elsewhere; n_chars follows the text; a null text becomes empty."""
    out = suffix.strip_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's target weight asks for; rows without words may stay, as they weigh nothing."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian 32-bit), with digests of the ids and of the bytes that they decode to."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("minhash_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mix_sources", mixing_stage),
    ("byte_bpe", token_stage),
]

#: SQL states neither the near-duplicate classes nor the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs
