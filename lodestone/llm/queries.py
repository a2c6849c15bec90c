"""The queries of the operators of this subpackage, over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import clustering, fingerprints, importance, language_id, media, mixing, near_duplicates, packing, quality, repeats, secrets, token_store, toxicity
from lodestone.session import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.query(_documents(spark, sf_dir))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.query(_documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.query(_documents(spark, sf_dir))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.query(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(_documents(spark, sf_dir))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.query(_documents(spark, sf_dir))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(_documents(spark, sf_dir))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.query(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.query(table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_best_fit_packing, op2_near_duplicates, op3_media_columns, op4_fingerprints, op5_token_store, op6_toxicity, op7_source_mixing,
    op8_quality, op9_language_id, op10_repeats, op11_secrets, op12_importance_resampling, op13_centroid_clustering,
)
QUERIES = {f.__name__: f for f in _ALL}

#: SQL for what it can express: no tokenizers, trained models, lexers, sketches or shuffles by hash. Tests hold the
#: other queries against a brute-force version, an exact round trip or held-out labels.
ORACLES: dict[str, str] = {"op12_importance_resampling": importance.ORACLE, "op13_centroid_clustering": clustering.ORACLE}
