"""A training corpus from documents: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import decontaminate, langid, line_dedup, packing, simhash
from rasterloom.llm.common import materialize, table
from rasterloom.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that are rejected go. The model is fitted on the labelled rows of docs."""
    ship(spark)
    return langid.known_language(docs, docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that many documents share stay in one of them."""
    ship(spark)
    return line_dedup.without_repeats(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    ship(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, packing.Packing(public_tokenizers.path("word_bpe_49k.json"), most_words=400_000, slice_bytes=2 << 20))  # workers still hold what the stages before remember


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language models and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
