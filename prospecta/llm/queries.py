"""The registered queries of the training-data operators: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, fm_index, mixing, piece_bpe, ppm, resampling, setsketch, simhash, sketches, suffix_bwt, turn_repair, weak_quality
from .common import number_files

#: Name of the vocabulary file that op3 and the pipeline's last stage use.
PIECES = "piece_bpe_32k.model"


def model_path(name: str = PIECES) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.digests(number_files(documents(spark, sf_dir)), 35)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.coded(documents(spark, sf_dir), model_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(documents(spark, sf_dir))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_bwt.digests(number_files(documents(spark, sf_dir)), 200)


def op6_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir), ppm.fold(F.col("doc_id")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(spark, f"{sf_dir}/documents.parquet")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_with_edited(documents(spark, sf_dir))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = number_files(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return resampling.resample(number_files(documents(spark, sf_dir)), target).select("doc_id", "n_features", "weight", "score", "rank")


def op12_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.cluster(number_files(documents(spark, sf_dir))).select("doc_id", "n_shingles", "component_id", "kept")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(number_files(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_chat_format, op3_sentencepiece, op4_quality, op5_suffix_array_dedup, op6_ppm_scores, op7_exact_dedup, op8_simhash, op9_source_mixing, op10_fingerprints, op11_importance_resampling, op12_setsketch_dedup, op13_turn_repair)}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
