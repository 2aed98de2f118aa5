"""Distinct counts and quantiles as stored sketches that are merged later.

A row of sketches per group (say, day and type) is a table like any other: it is written once, new days are
added to it, and any coarser grouping is answered from it without going back to the rows. A sketch has a
bounded size whatever it has seen, and the partial aggregates of a hot key are sketches as well.

Distinct counts are HLL sketches with a standard error of about 1.04 / sqrt(2 ** ``LG_K``), 1.6 %. Quantiles are
KLL sketches: the rank of what they return is off by less than about 1.65 % at ``KLL_K``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, FloatType, IntegralType, StringType

from millrace.names import quote

LG_K = 12
KLL_K = 200
ROWS = "rows"
DISTINCT = "distinct of "
RANKS = "ranks of "


def _countable(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    column = F.col(quote(name))
    return column if isinstance(kind, (IntegralType, StringType, BinaryType)) else column.cast("string")


def _measurable(df: DataFrame, name: str) -> Column:
    column = F.col(quote(name)).cast("double")
    # NaN has no rank among numbers.
    return F.nullif(column, F.lit(float("nan"))) if isinstance(df.schema[name].dataType, (DoubleType, FloatType)) else column


def summarise(df: DataFrame, keys: Sequence[str], distinct: Sequence[str] = (), ranked: Sequence[str] = ()) -> DataFrame:
    """One row per group of ``keys``: the keys, ``rows``, and a sketch per column of ``distinct`` (its values are
    counted) and of ``ranked`` (numbers, its quantiles). Nulls and NaN are not seen by sketches."""
    counted = [F.hll_sketch_agg(_countable(df, c), LG_K).alias(DISTINCT + c) for c in distinct]
    ranks = [F.kll_sketch_agg_double(_measurable(df, c), KLL_K).alias(RANKS + c) for c in ranked]
    return df.groupBy(*map(quote, keys)).agg(F.count(F.lit(1)).alias(ROWS), *counted, *ranks)


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for the coarser groups ``keys``, from rows of ``summarise`` or ``merge``, however many tables of
    them were put together."""
    merged = [F.sum(ROWS).alias(ROWS)]
    for name in sketches.columns:
        if name.startswith(DISTINCT):
            merged.append(F.hll_union_agg(quote(name)).alias(name))
        elif name.startswith(RANKS):
            merged.append(F.kll_merge_agg_double(quote(name), KLL_K).alias(name))
    return sketches.groupBy(*map(quote, keys)).agg(*merged)


def distinct_count(name: str) -> Column:
    """About how many values of column ``name`` there are."""
    return F.coalesce(F.hll_sketch_estimate(F.col(quote(DISTINCT + name))), F.lit(0))


def quantile(name: str, share: float) -> Column:
    """A value of column ``name`` at about this share of its order; null if there are none."""
    sketch = F.col(quote(RANKS + name))
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(share))))


def estimates(
    sketches: DataFrame, distinct: Mapping[str, str] = {}, quantiles: Mapping[str, tuple[str, float]] = {}
) -> DataFrame:
    """Keys, ``rows`` and the numbers asked for: ``distinct`` is new name → column, ``quantiles`` is new name →
    (column, share)."""
    keys = [quote(c) for c in sketches.columns if not c.startswith((DISTINCT, RANKS))]
    counts = [distinct_count(c).alias(n) for n, c in distinct.items()]
    values = [quantile(c, share).alias(n) for n, (c, share) in quantiles.items()]
    return sketches.select(*keys, *counts, *values)
