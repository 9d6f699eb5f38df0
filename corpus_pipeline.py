"""A corpus pipeline in five stages: toxicity, quality, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. `run` writes each stage's
rows to the shared folder and reads them again for the next. All stages but the last carry the columns of docs as they
are, whatever their names, and give no rows for an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, importance, mixing, simhash, toxicity
from brindle.llm.common import keep, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic (toxicity.keep_clean): nulls and empty texts score as no words do, repeated rows alike."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that importance resampling does not select (importance.keep_selected): nulls and empty texts have log weight 0."""
    return importance.keep_selected(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies (simhash.drop_near_copies): of null and empty texts one, of a null doc_id all."""
    return simhash.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their targets (mixing.take_copies): a text without words has size 0."""
    return mixing.take_copies(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whole (whether the ids decode to the text) of each row; null and empty texts have no ids."""
    coded = bpe.encode_documents(docs, public_tokenizers.path(bpe.VOCABULARY))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "whole")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL expresses none of the first three stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
