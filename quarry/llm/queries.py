"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import align, bpe, exact_dedup, kneser_ney, language, licenses, mixing, pii, quality, ranked, simhash, topk, vector_dedup

VOCABULARY, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.radix_groups(_table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, most=3)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), VOCABULARY)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sums of the same terms in another order may differ in the last digits
    return kneser_ney.score_documents(_table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op11_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.link_tokens(_table(spark, sf_dir, "documents"), VOCABULARY, PIECES)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_source_mix": op2_source_mix,
    "op3_pii": op3_pii,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_bpe": op6_bpe,
    "op7_topk": op7_topk,
    "op8_licenses": op8_licenses,
    "op9_language": op9_language,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_token_links": op11_token_links,
    "op12_ranked_search": op12_ranked_search,
    "op13_near_vectors": op13_near_vectors,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_source_mix": mixing.ORACLE,
    "op7_topk": topk.ORACLE,
    "op8_licenses": licenses.ORACLE,
    "op10_kneser_ney": kneser_ney.ORACLE,
    "op12_ranked_search": ranked.ORACLE,
    "op13_near_vectors": vector_dedup.ORACLE,
}
