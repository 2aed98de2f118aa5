"""The parquet tables the registered queries read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from millrace.session import tune
from millrace.tables import register

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_named(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Register those of the tables whose names occur in ``sql``."""
    tune(spark)
    words = set(re.findall(r"\w+", sql))
    for name in TABLES:
        if name in words:
            register(table(spark, sf_dir, name), name)
