"""A training corpus from ``documents``: rules, classifier, near-duplicates, mix, packed sequences.

``STAGES`` are run in order; each gets what the stage before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, packing, quality_model, quality_rules, simhash
from millrace.llm.common import table
from millrace.session import store


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the adaptive limits of their language and source."""
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted good. The model learns from the labelled rows of the whole table, which still
    has the documents that the rules rejected."""
    model = quality_model.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_model.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece and its place."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("SimHash near-duplicates", near_duplicates),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

#: Tokens, fingerprints and model scores are not SQL's: the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. Each result is stored, so a lost executor costs one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
