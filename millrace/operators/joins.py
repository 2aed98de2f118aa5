"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.hot import ROWS_PER_TASK
from millrace.session import store

MAX_PIECES = 1_000


def join_unique(
    left: DataFrame,
    right: DataFrame,
    on: dict[str, str],
    how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Join ``left`` (any number of rows per key) to ``right`` (one row per key at most).

    ``on`` maps left key to right key; ``how`` is inner, left, left_semi or left_anti. In all of
    these adaptive execution may split the left rows of a hot key over tasks, each with that
    key's one right row, and the session's settings make it do so. With ``null_safe`` a null
    key matches a null key.
    """
    same = Column.eqNullSafe if null_safe else Column.__eq__
    return left.join(right, reduce(and_, [same(left[l], right[r]) for l, r in on.items()]), how)


def foreign_key_join(
    facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, keep: str = "facts"
) -> DataFrame:
    """Outer joins between many-rows-per-key ``facts`` and one-row-per-key ``dim``.

    ``keep`` names the side whose unmatched rows survive: facts, dim or both. A plain
    dim-preserving outer join cannot split a hot fact key, so it is put together from the
    balanced inner (or fact-preserving) join and the dim rows whose key is not among the
    facts' distinct keys; the distinct is combined before the shuffle.
    """
    how = "left" if keep in ("facts", "both") else "inner"
    matched = join_unique(facts, dim, {fact_key: dim_key}, how)
    if keep == "facts":
        return matched
    present = facts.select(F.col(fact_key).alias("__k")).distinct()
    lonely = dim.join(present, dim[dim_key] == present["__k"], "left_anti")
    return matched.unionByName(lonely, allowMissingColumns=True)


def interval_count(
    points: DataFrame,
    intervals: DataFrame,
    value: str,
    low: str,
    high: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Number of ``points`` with ``low <= value < high`` for every interval row.

    That is the points below ``high`` less those below ``low``: a running count over the
    distinct values and bounds, looked up twice. No point ever meets an interval, so the work
    is that of a sort however many intervals overlap. Intervals without points, empty ones and
    those with a null bound get 0.
    """
    weighed = [
        df.where(F.col(c).isNotNull()).select(
            F.col(c).alias("__at"), F.lit(weight).cast("bigint").alias("__n")
        )
        for df, c, weight in ((points, value, 1), (intervals, low, 0), (intervals, high, 0))
    ]
    steps = reduce(DataFrame.unionByName, weighed).groupBy("__at").agg(F.sum("__n").alias("__n"))
    below = _counts_below(store(steps, "interval-steps"), rows_per_task)
    lows = below.select(F.col("__at").alias("__low_at"), F.col("__below").alias("__low"))
    highs = below.select(F.col("__at").alias("__high_at"), F.col("__below").alias("__high"))
    found = intervals.join(lows, F.col(low) == F.col("__low_at"), "left")
    found = found.join(highs, F.col(high) == F.col("__high_at"), "left")
    within = F.when(F.col(low) < F.col(high), F.col("__high") - F.col("__low")).otherwise(F.lit(0))
    return found.select(*intervals.columns, within.alias("n"))


def _counts_below(steps: DataFrame, rows_per_task: int) -> DataFrame:
    """``__below`` for each distinct ``__at``: the sum of ``__n`` over all smaller ones.

    The values are cut into runs of about ``rows_per_task``, at most ``MAX_PIECES``, each summed
    by itself; the table of the pieces' totals has a row per piece and is broadcast. ``steps`` is
    a stored table, so counting it reads no column.
    """
    pieces = min(MAX_PIECES, 1 + steps.count() // rows_per_task)
    shares = [i / pieces for i in range(1, pieces)]
    cuts = steps.agg(F.percentile_approx("__at", shares, 10_000)).first()[0] if shares else []
    at = F.col("__at")
    points = F.array(*[F.lit(c) for c in dict.fromkeys(cuts)])
    piece = F.size(F.filter(points, lambda c: c < at)) if cuts else F.lit(0)
    pieces = steps.withColumn("__piece", piece)
    earlier = (Window.unboundedPreceding, -1)
    before = F.sum("__total").over(Window.orderBy("__p").rowsBetween(*earlier))
    totals = pieces.groupBy(F.col("__piece").alias("__p")).agg(F.sum("__n").alias("__total"))
    totals = totals.select("__p", before.alias("__before"))
    own = F.sum("__n").over(Window.partitionBy("__piece").orderBy("__at").rowsBetween(*earlier))
    joined = pieces.withColumn("__own", own).join(
        F.broadcast(totals), F.col("__piece") == F.col("__p")
    )
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "__at", (F.coalesce("__own", zero) + F.coalesce("__before", zero)).alias("__below")
    )
