"""SQL transform: one query over any registered tables, kept under a table name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.tables import register


def query(spark: SparkSession, sql: str) -> DataFrame:
    """Run ``sql`` as a query. Being wrapped, it can be nothing else: DDL, a second
    statement and a trailing semicolon are parse errors. The newline lets the text end in a
    ``--`` comment."""
    return spark.sql(f"SELECT * FROM ({sql}\n)")


def sql_transform(spark: SparkSession, name: str, sql: str) -> DataFrame:
    """Define table ``name`` by ``sql``. A failing query leaves an earlier ``name`` as it
    was. The table is a view: nothing runs until a result is asked for, and the optimizer
    sees through chains of transforms."""
    return register(query(spark, sql), name)
