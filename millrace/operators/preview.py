"""Pages of a table, and what is known of its columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.json_safe import json_rows
from millrace.names import quote
from millrace.operators.ordering import Asc, comes_before, sort_columns

PAGE_ROWS = 100
TOP_ROWS = 100_000
CUTS = 64


def page(
    df: DataFrame,
    order: list[Asc],
    offset: int = 0,
    limit: int = PAGE_ROWS,
    top_rows: int = TOP_ROWS,
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in ``order`` (a total order, since tables have
    no order of their own); empty past the end.

    Near the start this is a top-k. That would hold ``offset + limit`` rows in one place, so
    further on the rows are counted between sampled values and only the stretch the page
    falls into is sorted, narrowed down until it is small. The result is the same.
    """
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    rows, by = df, list(order)
    while by and offset + limit > top_rows:
        narrowed = _narrow(rows, by, offset, limit)
        if narrowed is None:
            break
        rows, by, offset = narrowed
    return rows.orderBy(*sort_columns(order)).offset(offset).limit(limit)


def _narrow(df: DataFrame, order: list[Asc], offset: int, limit: int):
    """(rows of the stretch the page lies in, sort columns left, offset within it), or None
    if it is all of ``df``.

    Only the first sort column is cut, at sampled values: its rows fall between two values
    or on one. If the page lies on one value, the next column takes over. The bounds are
    plain comparisons on a column, which a parquet scan can use to skip.
    """
    lead = order[0]
    column, kind = F.col(quote(lead.name)), df.schema[lead.name].dataType
    values = df.select(column)
    total = values.count()
    if offset >= total:
        return df.where("false"), [], 0
    sample = values.sample(fraction=min(1.0, 20.0 * CUTS / total), seed=11)
    sample = [r[0] for r in sample.orderBy(lead.column()).collect()]
    step = max(1, len(sample) // CUTS)
    cuts = list(dict.fromkeys(sample[step - 1 :: step]))
    if not cuts:
        return None
    points = [F.lit(c).cast(kind) for c in cuts]
    past = [comes_before(F.struct(p.alias(lead.name)), [lead]) for p in points]
    on = [column.eqNullSafe(p) for p in points]
    counted = values.groupBy(_piece(past, on, 0, len(cuts)).alias("p")).count().collect()
    sizes = dict.fromkeys(range(2 * len(cuts) + 1), 0) | {r["p"]: r["count"] for r in counted}
    first, before = 0, 0
    while before + sizes[first] <= offset:
        before += sizes[first]
        first += 1
    last, upto = first, before + sizes[first]
    while upto < offset + limit and last < 2 * len(cuts):
        last += 1
        upto += sizes[last]
    if first == last and first % 2:
        return df.where(on[first // 2]), order[1:], offset - before
    if upto - before >= total:
        return None
    inside = F.lit(True)
    if first % 2:
        inside = inside & (past[first // 2] | on[first // 2])
    elif first:
        inside = inside & past[first // 2 - 1]
    if last % 2:
        inside = inside & ~past[last // 2]
    elif last < 2 * len(cuts):
        inside = inside & ~past[last // 2] & ~on[last // 2]
    return df.where(inside), order, offset - before


def _piece(past: list[Column], on: list[Column], low: int, high: int) -> Column:
    """``2 i + 1`` for rows on cut ``i``, ``2 i`` for rows between it and the one before."""
    if low == high:
        between = F.lit(2 * low)
        return between if low == len(on) else F.when(on[low], 2 * low + 1).otherwise(between)
    middle = (low + high) // 2
    return F.when(past[middle], _piece(past, on, middle + 1, high)).otherwise(
        _piece(past, on, low, middle)
    )


def describe(df: DataFrame) -> DataFrame:
    """Column position, name and type with the table's row count: no rows are fetched."""
    spark = df.sparkSession
    listed = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    columns = spark.createDataFrame(listed, "pos int, name string, type string")
    return columns.withColumn("total_rows", F.lit(df.count()).cast("bigint"))


def preview(
    df: DataFrame,
    order: list[Asc],
    offset: int = 0,
    limit: int = PAGE_ROWS,
    total_rows: int | None = None,
) -> dict:
    """One page as plain Python values that ``json.dumps`` takes, with columns, types and
    row count. Pass ``total_rows`` where it is known, to save the count."""
    rows = json_rows(page(df, order, offset, limit)).collect()
    return {
        "kind": "table",
        "columns": df.columns,
        "column_types": [t for _, t in df.dtypes],
        "rows": [json.loads(r["row"]) for r in rows],
        "total_rows": df.count() if total_rows is None else total_rows,
        "offset": offset,
        "limit": limit,
    }
