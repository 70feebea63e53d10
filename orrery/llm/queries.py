"""The queries of this subpackage, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, crf, fertility, licenses, near_dedup, packing, suffix_dedup, warc
from ._shared import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(spark, table(spark, sf_dir, "pages"))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100, against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.filter("vec_id % 100 = 0"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility(table(spark, sf_dir, "documents"))


def op8_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_conversations(table(spark, sf_dir, "conversations"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_warc_zstd, op3_line_crf, op4_learned_ann, op5_suffix_dedup, op6_license_scan, op7_fertility, op8_chat_template, op9_byte_bpe, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_zstd": warc.SQL, "op8_chat_template": chat.SQL}
