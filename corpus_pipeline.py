"""From raw documents to token ids: filter, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet in the
shared folder and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``; the last returns doc_id, n_tokens, ids (packed little-endian
unsigned 32-bit integers) and text (decoded from the ids). A document that the mix takes
several times is several rows.

Defined results: as in the operators. A stage given an empty table returns an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from tidemark.llm.common import store, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs, seed=17)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, decoded=True)
    return rows.select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Similarity links, learned scores and token merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
