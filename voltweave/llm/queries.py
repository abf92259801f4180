"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_text, language_id, line_dedup, lm_score, media, mixing, packing, simhash, token_files


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~language_id.held_out(3, 1)))
    return language_id.identify(docs, model).select("doc_id", language_id.held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.write_and_describe(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.LineDedup(_read(spark, sf_dir, "documents", "doc_id", "text")).report()


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(_read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_media_columns": op4_media_columns,
    "op5_html_text": op5_html_text,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_files": op10_token_files,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op6_embedding_dedup": embedding_dedup.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
}
