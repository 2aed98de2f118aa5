"""Finding keys that hold more rows than one task should take.

No more than ``MAX_HOT`` keys are listed, the largest first, so the list can be collected and
broadcast whatever the data looks like. A key that is left out has fewer than
``total / MAX_HOT`` rows: five million where the table has 10^12.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_TASK = 5_000_000
MAX_HOT = 200_000


@dataclass
class HotKeys:
    """``threshold`` is the size of the pieces hot keys are cut into: no more than about
    ``MAX_HOT`` pieces in all."""

    keys: list[str]
    schema: T.StructType
    threshold: int
    rows: list[tuple] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.rows)

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)


def hot_keys(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> HotKeys:
    """Keys of ``df`` with more than ``rows_per_task`` rows: one map-side combined count."""
    schema = T.StructType([T.StructField(k, df.schema[k].dataType, True) for k in keys])
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    heavy = counted.where(F.col("__n") > rows_per_task)
    listed = heavy.orderBy(F.desc("__n")).limit(MAX_HOT).collect()
    threshold = max(rows_per_task, sum(r["__n"] for r in listed) // MAX_HOT)
    return HotKeys(keys, schema, threshold, [tuple(r)[:-1] for r in listed])


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]):
    """``left.k <=> right.k`` for all keys."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond
