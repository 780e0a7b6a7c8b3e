"""Queries of the training-data operators, by name, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op2_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_files import tokenize_documents

    return tokenize_documents(spark, _table(spark, sf_dir, "documents"))


def op3_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


def op4_byte_prefix_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op5_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix_documents

    return mix_documents(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import link_documents

    return link_documents(_table(spark, sf_dir, "documents"))


def op7_seeded_alignment_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.importance import sample_documents

    return sample_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fingerprint import fingerprint_documents

    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op10_weakly_supervised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import find_personal_data

    return find_personal_data(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_arrow_token_files": op2_arrow_token_files,
    "op3_sharded_warc": op3_sharded_warc,
    "op4_byte_prefix_sharding": op4_byte_prefix_sharding,
    "op5_weighted_mixing": op5_weighted_mixing,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_seeded_alignment_decontamination": op7_seeded_alignment_decontamination,
    "op8_importance_resampling": op8_importance_resampling,
    "op9_bottom_k_fingerprints": op9_bottom_k_fingerprints,
    "op10_weakly_supervised_pii": op10_weakly_supervised_pii,
}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": oracles.REPEATS,
    "op3_sharded_warc": oracles.WARC,
    "op4_byte_prefix_sharding": oracles.SHARDS,
    "op5_weighted_mixing": oracles.MIX,
    "op6_ngram_jaccard_join": oracles.JOIN,
}
