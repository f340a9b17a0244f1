"""A training-data pipeline: documents are filtered, deduplicated, mixed and encoded, stage after stage.

Each stage is written to the shared folder and read again, so that a lost executor costs no more than a part of the
stage that runs. All stages take any further columns, whatever their names, and return them, but for the last one; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, exact_dedup, mixing, quality, simhash
from quarry.llm.storage import Scratch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; null and empty texts are judged like any other, repeated rows
    each by itself."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; null texts are empty, and a null id is the smallest. Of rows that
    repeat in full one stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, over shingles of five words, the document with the smallest id, a null id last: SimHash and
    vantage-point trees link what is close, an exact join the rest. Texts without a
    word are one group; a text of fewer words is one shingle."""
    return simhash.keep_one(docs, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null source is one of its own; texts without a word weigh nothing."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to; a null text is empty."""
    return bpe.encode_digests(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode),
]

#: SQL has no trees, order sampling or BPE: the stages are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        last, docs = docs, scratch.store(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(last)
    return docs
