"""One query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, classifier, clusters, decontaminate, html_text, neardup, oracles, pieces, pii, quality, resample, sharding, substrings, tokens
from .common import table


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op4_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), path or tokenizer("byte_bpe_50k.json"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op8_pieces(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), path or tokenizer("piece_bpe_32k.model"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.sort_means(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2)


def op12_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), seed=2024, percent=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_sharding": op2_sharding,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_html": op5_html,
    "op6_decontamination": decontaminate.query,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_pieces": op8_pieces,
    "op9_chat": op9_chat,
    "op10_personal_data": op10_personal_data,
    "op11_clusters": op11_clusters,
    "op12_classifier": op12_classifier,
    "op13_resampling": op13_resampling,
}

ORACLES: dict[str, str] = {
    "op1_quality": oracles.QUALITY,
    "op3_suffix_dedup": oracles.REPEATS,
    "op5_html": oracles.PAGES,
    "op6_decontamination": decontaminate.ORACLE,
    "op7_near_duplicates": oracles.NEAR_DUPLICATES,
    "op9_chat": chat.ORACLE,
    "op11_clusters": clusters.oracle(),
    "op13_resampling": resample.ORACLE,
}
