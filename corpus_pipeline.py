"""From raw documents to token files: five stages, each by one training-data operator.

Quality rules drop bad documents, SimHash keeps one document of each group of
near copies, decontamination drops documents that hold a test item, mixing
takes documents to target weights (one row for each time), and the last stage
writes token files and returns what they hold.

Edge cases: a null or empty text has too few words and goes in the first stage;
very long texts pass every stage whole. Rows without doc_id stay in the second
stage, as they can't be told apart, and in the others are judged like any row.
Rows that repeat a doc_id go or stay as their texts decide; of a group of near
copies the least doc_id stays, with all its rows. A missing language or source
is one of its own. Ties in mixing are broken by a seeded hash. Columns beyond
those of documents are dropped, whatever their names. An empty table gives an
empty result. A missing or null benchmark item removes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from placard.llm import decontamination, mixing, quality_rules, simhash_dedup, token_files
from placard.llm.common import fresh_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_digest(docs, token_files.default_tokenizer())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Fingerprints and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
