"""EXCEPT ALL and INTERSECT ALL on counted rows.

Both sides are counted per distinct row (combined on the map side), so a row with very many
copies is shuffled as one. Its remaining copies are written out in portions that different
tasks take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.names import quote

PORTION = 1_000_000


def _counts(left: DataFrame, right: DataFrame) -> DataFrame:
    names = [quote(c) for c in left.columns]
    a = left.groupBy(*names).agg(F.count(F.lit(1)).alias("__a"))
    b = right.toDF(*left.columns).groupBy(*names).agg(F.count(F.lit(1)).alias("__b"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy(*names).agg(
        F.coalesce(F.sum("__a"), F.lit(0)).alias("__a"),
        F.coalesce(F.sum("__b"), F.lit(0)).alias("__b"),
    )


def _copies(counted: DataFrame, n, portion: int) -> DataFrame:
    names = [quote(c) for c in counted.columns if c not in ("__a", "__b")]
    kept = counted.select(*names, n.alias("__n")).where("__n > 0")
    last = F.floor((F.col("__n") - 1) / portion).cast("bigint")
    parts = kept.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    size = F.least(F.lit(portion), F.col("__n") - F.col("__part") * portion).cast("int")
    # A given number of partitions is kept as it is; without one, adaptive execution would
    # put these few rows, and so all the copies, into one task.
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = parts.withColumn("__size", size).repartition(tasks, *names, "__part")
    return spread.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__size")))).select(*names)


def except_all(left: DataFrame, right: DataFrame, portion: int = PORTION) -> DataFrame:
    return _copies(_counts(left, right), F.col("__a") - F.col("__b"), portion)


def intersect_all(left: DataFrame, right: DataFrame, portion: int = PORTION) -> DataFrame:
    return _copies(_counts(left, right), F.least("__a", "__b"), portion)
