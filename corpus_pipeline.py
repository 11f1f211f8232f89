"""The corpus pipeline: documents of good quality, one of each near-duplicate group, without secrets, mixed by source, as token ids.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. run() writes each stage's rows as Parquet
in the shared folder and rereads them, so a lost executor costs at most the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import bpe, mixing, quality, secrets, simhash
from docquarry.llm.shared import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group with a similarity of 0.8 or more over five-word shingles."""
    return simhash.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked, and n_chars that agrees with the text."""
    return secrets.redacted(docs, count_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emitted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, split_chars and token_bytes (ids as little-endian unsigned 32-bit integers)."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("secrets", hide_secrets), ("mix", mix_sources), ("encode", encode)]

#: SQL can express neither the trees, nor SimHash over all documents, nor byte-level BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
