"""Training-corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of documents, whatever further columns there are and whatever they are called.
``run`` writes each stage's rows to the shared scratch folder and rereads them as the next one's documents.

Null and empty texts fail the quality rules and go; rows with a null source are one host. Very long texts are judged whole and
packed in pieces. Of texts that link, the least doc_id stays (a tie has none smaller); rows that repeat share a doc_id and
are judged by row, but in the near-copy stage they stay or go together. A null doc_id links with nothing. An empty table
gives an empty result, and an empty benchmark drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointweave.llm import decontaminate, jaccard, packing, quality_rules, secrets
from pointweave.llm.common import materialize, table
from pointweave.llm.registry import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a secret go."""
    return secrets.drop_leaky(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", keep_good), ("ngram_jaccard_join", keep_one), ("benchmark_decontamination", drop_leaks), ("secret_scan", drop_secrets), ("best_fit_packing", pack)]

#: SQL can't express min-hash groups, spaced seeds or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
