"""The queries op1 to op13 and their SQL, for the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact_search, html_extract, language, line_dedup, near_dedup, packing, piece_codec, quality, resample, spelling, token_counts, token_store
from tidemark.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_back(spark, token_store.write(table(spark, sf_dir, "documents")))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(language.training_rows(docs)))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_quality_rules, op3_token_store, op4_piece_codec, op5_minhash_near_dedup, op6_language_id, op7_exact_top_k, op8_line_dedup, op9_best_fit_packing, op10_token_counts, op11_decontamination, op12_importance_resampling, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality.ORACLE_SQL, "op5_minhash_near_dedup": near_dedup.ORACLE_SQL, "op7_exact_top_k": exact_search.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op11_decontamination": decontaminate.ORACLE_SQL, "op12_importance_resampling": resample.ORACLE_SQL, "op13_spelling_variants": spelling.ORACLE_SQL,
    }
