"""Exact quantiles without holding a group's values in one place."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.joins import join_unique

ACCURACY = 100_000


def exact_quantiles(
    df: DataFrame, keys: list[str], column: str, shares: dict[str, float], accuracy: int = ACCURACY
) -> DataFrame:
    """Linear-interpolated quantiles of ``column`` per group of ``keys`` (nulls ignored).
    ``shares`` maps an output name to the share below it.

    One mergeable sketch brackets all answers to within a few ``1/accuracy`` of the ranks,
    which its error bound guarantees. The brackets' ends cut the values into segments: rows
    of a segment outside every bracket are only counted; those inside are counted per value,
    sorted and searched for the exact ranks.
    """
    slack = 2.0 / accuracy
    probes = [max(0.0, min(1.0, p + d)) for p in shares.values() for d in (-slack, slack)]
    values = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("__v"))
    sketch = (
        values.groupBy(*keys)
        .agg(
            F.percentile_approx("__v", probes, accuracy).alias("__b"),
            F.count(F.lit(1)).alias("__n"),
        )
        .select(
            *[F.col(k).alias(f"__k_{k}") for k in keys],
            "__b",
            "__n",
            F.array_sort(F.array_distinct("__b")).alias("__ends"),
        )
    )
    placed = join_unique(values, sketch, {k: f"__k_{k}" for k in keys}, null_safe=True)
    v, ends = F.col("__v"), F.col("__ends")
    segment = 2 * F.size(F.filter(ends, lambda e: e < v)) + F.array_contains(ends, v).cast("int")
    brackets = [(F.col("__b")[2 * i], F.col("__b")[2 * i + 1]) for i in range(len(shares))]
    inside = reduce(or_, [(lo <= v) & (v <= hi) for lo, hi in brackets])
    counted = placed.groupBy(
        *keys, "__n", segment.alias("__segment"), F.when(inside, v).alias("__at")
    ).agg(
        F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__min"), F.max("__v").alias("__max")
    )
    w = Window.partitionBy(*keys).orderBy("__segment", "__at")
    upto = F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = counted.withColumn("__end", upto)

    def value_at(rank: Column) -> Column:
        # Of rows that were only counted, the first and the last have a known value.
        first, last = F.col("__end") - F.col("__c"), F.col("__end") - 1
        known = (
            F.when(rank == last, F.col("__max"))
            .when(rank == first, F.col("__min"))
            .when((first < rank) & (rank < last), F.col("__at"))
        )
        return F.max(known)

    ranks = {name: (F.col("__n") - 1) * F.lit(float(p)) for name, p in shares.items()}
    picked = runs.groupBy(*keys, "__n").agg(
        *[value_at(F.floor(rank)).alias(f"__a_{name}") for name, rank in ranks.items()],
        *[value_at(F.ceil(rank)).alias(f"__z_{name}") for name, rank in ranks.items()],
    )

    def between(name: str) -> Column:
        a, z, rank = F.col(f"__a_{name}"), F.col(f"__z_{name}"), ranks[name]
        return (a + (z - a) * (rank - F.floor(rank))).alias(name)

    return picked.select(*keys, *[between(name) for name in shares])


def exact_quantile(
    df: DataFrame, keys: list[str], column: str, p: float, out: str, accuracy: int = ACCURACY
) -> DataFrame:
    """One of ``exact_quantiles``."""
    return exact_quantiles(df, keys, column, {out: p}, accuracy)
