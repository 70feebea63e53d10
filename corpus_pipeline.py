"""A corpus from documents: five stages, each of which works on all that the one before it kept.

Every stage but the last returns the columns of documents; each is written to the shared folder and read again.

Defined results, by stage: null, empty and blank texts go with the quality classifier. Quality rules see what is left, of
any length. Near-dedup keeps one row of each group, one of rows that repeat id and text, all texts that differ under one
id, and every row without an id. Repeated passages are cut from texts of any length, and a row of which nothing is left
goes. Packing writes every token of what is left. Of equal documents the least id stays. Columns beside doc_id, text and
lang are carried along, whatever their names; empty tables give no windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import crf, fertility, near_dedup, packing, suffix_dedup
from orrery.llm._shared import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose length-weighted chance of good lines is low, and those without a word."""
    return crf.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose token statistics are out of their language's band."""
    return fertility.keep_fertile(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the least doc_id."""
    return near_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they stand first and are cut elsewhere."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", pack),
]

#: learnt weights, vocabularies and suffix arrays are beyond SQL; tests hold each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
