"""The training corpus, stage by stage: quality rules, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the
columns of documents. ``run`` writes each stage as Parquet into the shared folder and reads it
again for the next, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slideloom.llm.curriculum import mix
from slideloom.llm.linequality import clean
from slideloom.llm.nearcopies import keep_one
from slideloom.llm.packing import pack, pieces
from slideloom.llm.queries import tokenizer
from slideloom.llm.secrets import redact
from slideloom.plans.scale import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that their host repeats."""
    return clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): that with the smallest id."""
    return keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] in place of secrets."""
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The readings of the training run in order; a document read twice is there twice."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every reading with their sequence and place in it."""
    return pack(pieces(docs, tokenizer()))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("packing", packing),
]

#: Packing needs the tokenizer and SimHash its hash: no SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
