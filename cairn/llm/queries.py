"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bpe_encode, decontaminate, html_text, language_id, line_dup, near_dup, pii, substring_dup, token_counts, vector_forest
from cairn.llm.frames import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode.round_trip(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op5_substring_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dup.digests(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forest.search(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_html_text": op3_html_text,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_substring_duplicates": op5_substring_duplicates,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_runs": op7_line_runs,
    "op8_personal_data": op8_personal_data,
    "op9_vector_forest": op9_vector_forest,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op7_line_runs": line_dup.ORACLE_SQL,
}
