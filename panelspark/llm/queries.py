"""The queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, dialogue, exact, language, merkle, mixing, near, ngrams, oracles, passages, pii, secrets, store, suffixes, tokenfiles


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = store.new_path(spark, "token-ids")
    index = tokenfiles.write_ids(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.read_ids(spark, folder, index)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.digest(exact.duplicates(documents(spark, sf_dir), keep="largest"))


def op3_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.digest(near.near_duplicates(documents(spark, sf_dir), words=3, percent=85))


def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(documents(spark, sf_dir)))


def op5_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.without_copies(documents(spark, sf_dir)))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.digest(ngrams.scored(documents(spark, sf_dir)))


def op7_passage_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(passages.without_passages(documents(spark, sf_dir)))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(documents(spark, sf_dir)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(language.languages(documents(spark, sf_dir)))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op11_talk_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repairs(dialogue.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone="gone")


def op12_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(documents(spark, sf_dir)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return merkle.manifest(docs, altered=merkle.lowered(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_ids, op2_exact_dedup, op3_odd_sketches, op4_secret_links, op5_previous_factors, op6_kneser_ney, op7_passage_doubling, op8_curriculum_mix, op9_language_id, op10_decontaminate, op11_talk_repair, op12_context_pii, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    """SQL for what it can state; the others are tested against plain versions."""
    return dict(oracles.SQL)
