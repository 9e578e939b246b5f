"""From raw documents to packed training sequences: five stages, each an operator of ``tessera.llm``.

Each stage is ``f(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next
stage's documents, so that every stage starts from data that survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, lines, neardup, packing, quality
from tessera.llm.queries import tokenizer_path
from tessera.llm.shared import crc_of_id, scratch, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents evidently in a learned language; texts without a letter, noise and other languages go."""
    small = docs.where(~F.coalesce(crc_of_id() % 4 == 2, F.lit(False)))
    model = language.train(small)
    return language.accepted(docs.select(*COLUMNS), model, language.calibrate(small, model))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels are those of ``sf_dir``."""
    labels = quality.learnable(table(spark, sf_dir, "labels"), crc_of_id() % 5 == 0)
    return quality.keep_accepted(docs.select(*COLUMNS), labels)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; n_chars follows the text."""
    return lines.drop_recurring(docs).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id."""
    return neardup.keep_one(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in 2048-token sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Trained models and signatures are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(staged(stage(spark, docs, sf_dir), f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
