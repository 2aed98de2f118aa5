"""Named tables: register, append, look up, drop.

A table is a view by name, so any name is legal. A table rows can be added to is a parquet
directory in shared storage; the session remembers which one by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.names import quote, safe_path_part
from millrace.session import workspace


def _setting(name: str) -> str:
    return f"millrace.table.{name.lower()}"


def register(df: DataFrame, name: str) -> DataFrame:
    """Make ``df`` readable as ``name``, replacing any earlier table of that name."""
    df.createOrReplaceTempView(quote(name))
    df.sparkSession.conf.unset(_setting(name))
    return df


def register_files(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Make a parquet directory readable as ``name``, so that rows can be appended to it."""
    df = register(spark.read.parquet(path), name)
    spark.conf.set(_setting(name), path)
    return df


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to shared storage as table ``name``, replacing an earlier one. The new
    files are complete before the name is moved to them, so ``df`` may read the table it
    replaces and a failed write changes nothing."""
    spark = df.sparkSession
    path = path or workspace(spark, safe_path_part(name))
    df.write.mode("errorifexists").parquet(path)
    return register_files(spark, name, path)


def append(df: DataFrame, name: str) -> DataFrame:
    """Add the rows of ``df`` to table ``name``. Columns go by position and take the
    table's names and types; a value that does not fit its type is an error and adds
    nothing."""
    spark = df.sparkSession
    path = spark.conf.get(_setting(name), None)
    if path is None:
        if not exists(spark, name):
            raise ValueError(f"there is no table {name!r}")
        # A view, or the stored result of a node: that stays as it is, and the table goes on as a copy.
        materialize(spark.table(quote(name)), name)
        path = spark.conf.get(_setting(name))
    target = spark.table(quote(name)).schema.fields
    if len(target) != len(df.columns):
        raise ValueError(f"{name!r} has {len(target)} columns, not {len(df.columns)}")
    cols = [
        F.col(quote(c)).cast(f.dataType).alias(f.name) for c, f in zip(df.columns, target)
    ]
    df.select(*cols).write.mode("append").parquet(path)
    return register_files(spark, name, path)


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(quote(name))


def drop(spark: SparkSession, name: str) -> bool:
    """Forget table ``name``; no error when there is none. Tells whether there was one.
    Its files stay: other names and earlier results may read them."""
    spark.conf.unset(_setting(name))
    return spark.catalog.dropTempView(name)
