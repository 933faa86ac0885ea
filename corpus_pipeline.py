"""Corpus pipeline: toxicity, quality rules, near-duplicates, mixing, tokens. Part of the subpackage smishlake.llm.

Each stage takes (spark, docs, sf_dir), works on all rows of its docs and returns a DataFrame; run() writes each result
as Parquet in the shared folder and reads it again for the next stage. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from smishlake.llm import byte_bpe, cube_mix, host_rules, jaccard_join, toxicity
from smishlake.llm.common import store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that are predicted toxic go. Learned from the labelled documents among docs."""
    return toxicity.filter_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the base or the host-level rules reject go."""
    return host_rules.filter_kept(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near-duplicates the document with the smallest doc_id stays."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents stand as often as the mix takes them: not at all, once or twice."""
    return cube_mix.repeat_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: doc_id, n_tokens and digests of ids and decoded bytes, one row per row."""
    return byte_bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("jaccard_join", drop_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenize),
]

#: The classifier, the cube method and byte pair merging are not SQL; tests/llm hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
