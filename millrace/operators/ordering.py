"""Ordered (window) operators that split hot partitions.

Spark sends each window partition to one task. That is right for ordinary keys and is
what happens here for them. When a key holds more rows than one task should take, its
rows are cut into consecutive pieces of the sort order at sampled cut points; the window
runs per piece and the totals of the earlier pieces are added. The cut points only decide
how even the pieces are; the result is exact for any choice of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.hot import ROWS_PER_TASK, HotKeys, hot_keys, null_safe
from millrace.operators.joins import join_unique

OVERSAMPLE = 20
FAN = 64


@dataclass(frozen=True)
class Asc:
    """One sort column; nulls come last unless told otherwise."""

    name: str
    nulls_first: bool = False

    def column(self) -> Column:
        c = F.col(self.name)
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def less(self, a: Column, b: Column) -> Column:
        return a < b


@dataclass(frozen=True)
class Desc(Asc):
    def column(self) -> Column:
        c = F.col(self.name)
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()

    def less(self, a: Column, b: Column) -> Column:
        return a > b


def sort_columns(order: list[Asc]) -> list[Column]:
    return [o.column() for o in order]


def comes_before(point: Column, order: list[Asc]) -> Column:
    """True where struct ``point`` sorts strictly before the row's order columns."""
    verdict = F.lit(False)
    for o in reversed(order):
        a, b = point.getField(o.name), F.col(o.name)
        null_side = (a.isNull() & b.isNotNull()) if o.nulls_first else (a.isNotNull() & b.isNull())
        smaller = F.coalesce(o.less(a, b), F.lit(False)) | null_side
        verdict = smaller | (a.eqNullSafe(b) & verdict)
    return verdict


def position_among(points: Column, order: list[Asc]) -> Column:
    """How many cut points sort before the row. ``points`` is an array of arrays: whole
    runs are counted by their last point, then the one run the row falls into is searched."""
    runs = F.size(F.filter(points, lambda run: comes_before(F.element_at(run, -1), order)))
    run = F.get(points, runs)
    inside = F.size(F.filter(run, lambda p: comes_before(p, order)))
    return F.when(run.isNull(), F.size(F.flatten(points))).otherwise(runs * FAN + inside)


def cut_hot(
    df: DataFrame, keys: list[str], order: list[Asc], rows_per_task: int
) -> tuple[DataFrame, HotKeys]:
    """Add ``__piece`` (0 … per hot key, 0 for all others) and ``__hot`` to ``df``.

    One cut point is kept per ``threshold`` rows of a hot key, so there are never more
    than ``MAX_HOT`` cut points in all and the table of them can be broadcast.
    """
    hot = hot_keys(df, keys, rows_per_task)
    if not hot:
        return df, hot
    spark = df.sparkSession
    names = [o.name for o in order]
    listed = F.broadcast(hot.frame(spark))
    sample = (
        df.select(*dict.fromkeys(keys + names))
        .join(listed, null_safe(df, listed, keys), "left_semi")
        .sample(fraction=min(1.0, OVERSAMPLE / hot.threshold), seed=7)
    )
    every = OVERSAMPLE if hot.threshold > OVERSAMPLE else hot.threshold
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort_columns(order)))
    chosen = (
        sample.withColumn("__nth", nth)
        .where(F.col("__nth") % every == 0)
        .select(*keys, F.struct(*names).alias("__p"), "__nth")
    )
    by_key: dict[str, list] = {repr(key): [] for key in hot.rows}
    for r in chosen.orderBy("__nth").collect():
        by_key[repr(tuple(r[: len(keys)]))].append(r["__p"])
    point_type = chosen.schema["__p"].dataType
    schema = T.StructType(
        [T.StructField(f"__k{i}", hot.schema[i].dataType) for i in range(len(keys))]
        + [T.StructField("__points", T.ArrayType(T.ArrayType(point_type)))]
    )
    table = []
    for key in hot.rows:
        pts = by_key[repr(key)]
        table.append(key + ([pts[i : i + FAN] for i in range(0, len(pts), FAN)],))
    points = F.broadcast(spark.createDataFrame(table, schema))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & df[k].eqNullSafe(points[f"__k{i}"])
    pieces = (
        df.join(points, cond, "left")
        .withColumn("__hot", F.col("__points").isNotNull())
        .withColumn(
            "__piece",
            F.when(F.col("__hot"), position_among(F.col("__points"), order)).otherwise(F.lit(0)),
        )
        .select(*df.columns, "__hot", "__piece")
    )
    return pieces, hot


def _earlier_pieces(keys: list[str]):
    return (
        Window.partitionBy(*keys)
        .orderBy("__piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _with_piece_table(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Attach per-piece values. ``table`` has a row per piece of a hot key: bounded."""
    own = table.columns
    renamed = table.toDF(*[f"__t_{c}" if c in keys + ["__piece"] else c for c in own])
    cond = rows["__piece"] == renamed["__t___piece"]
    for k in keys:
        cond = cond & rows[k].eqNullSafe(renamed[f"__t_{k}"])
    joined = rows.join(F.broadcast(renamed), cond, "left")
    return joined.drop("__t___piece", *[f"__t_{k}" for k in keys])


def rank_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Asc],
    row_number: str | None = None,
    rank: str | None = None,
    dense_rank: str | None = None,
    ntile: tuple[str, int] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add the asked-for ranking columns (bigint) over ``PARTITION BY keys ORDER BY order``."""
    pieces, hot = cut_hot(df, keys, order, rows_per_task)
    if not hot:
        w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
        wanted = {row_number: F.row_number(), rank: F.rank(), dense_rank: F.dense_rank()}
        if ntile:
            wanted[ntile[0]] = F.ntile(ntile[1])
        cols = {n: f.over(w).cast("bigint") for n, f in wanted.items() if n}
        return df.withColumns(cols)
    group = Window.partitionBy(*keys, "__piece")
    w = group.orderBy(*sort_columns(order))
    local = pieces.withColumns(
        {
            "__rn": F.row_number().over(w).cast("bigint"),
            "__rk": F.rank().over(w).cast("bigint"),
            "__dr": F.dense_rank().over(w).cast("bigint"),
            "__size": F.count(F.lit(1)).over(group),
        }
    )
    totals = (
        local.where("__hot")
        .groupBy(*keys, "__piece")
        .agg(F.count(F.lit(1)).alias("__n"), F.max("__dr").alias("__d"))
        .withColumns(
            {
                "__before": F.sum("__n").over(_earlier_pieces(keys)),
                "__dbefore": F.sum("__d").over(_earlier_pieces(keys)),
                "__total": F.sum("__n").over(Window.partitionBy(*keys)),
            }
        )
        .drop("__n", "__d")
    )
    out = _with_piece_table(local, totals, keys)
    before = F.coalesce("__before", F.lit(0))
    rn = F.col("__rn") + before
    cols = {}
    if row_number:
        cols[row_number] = rn
    if rank:
        cols[rank] = F.col("__rk") + before
    if dense_rank:
        cols[dense_rank] = F.col("__dr") + F.coalesce("__dbefore", F.lit(0))
    if ntile:
        cols[ntile[0]] = _tile(rn, F.coalesce("__total", "__size"), ntile[1])
    return out.select(*df.columns, *[c.alias(n) for n, c in cols.items()])


def _tile(rn: Column, total: Column, tiles: int) -> Column:
    """Tile of row ``rn``: the first ``total % tiles`` tiles have one row more."""
    small = F.floor(total / tiles).cast("bigint")
    extra = total % tiles
    wide = extra * (small + 1)
    first = F.floor((rn - 1) / (small + 1)) + 1
    later = extra + F.floor((rn - 1 - wide) / F.greatest(small, F.lit(1))) + 1
    return F.when(rn <= wide, first).otherwise(later).cast("bigint")


def rows_frame(
    df: DataFrame,
    keys: list[str],
    order: list[Asc],
    columns: dict[str, Callable],
    before: int = 0,
    after: int = 0,
    first: dict[str, str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``columns`` maps an output name to a function from an ordered window to a column, as
    in ``{"p": lambda w: F.lag("value").over(w)}``. ``first`` maps an output name to the
    column whose first value in the partition is wanted. ``order`` must be a total order.
    """
    first = first or {}
    hot = hot_keys(df, keys, rows_per_task)
    if not hot:
        w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
        cols = {n: make(w) for n, make in columns.items()}
        cols |= {n: F.first_value(c).over(w) for n, c in first.items()}
        return df.withColumns(cols)
    size = max(hot.threshold, before, after, 1)
    numbered = rank_rows(df, keys, order, row_number="__pos", rows_per_task=rows_per_task)
    pos, home = F.col("__pos"), F.floor((F.col("__pos") - 1) / size).cast("bigint")
    # A row near the end of a chunk is also shown to the next one, and the other way round.
    targets = F.filter(
        F.array(
            home,
            F.when(pos > (home + 1) * size - before, home + 1),
            F.when((pos <= home * size + after) & (home > 0), home - 1),
        ),
        lambda c: c.isNotNull(),
    )
    spread = numbered.withColumn("__home", home).withColumn("__chunk", F.explode(targets))
    w = Window.partitionBy(*keys, "__chunk").orderBy("__pos")
    framed = spread.withColumns({n: make(w) for n, make in columns.items()})
    framed = framed.where(F.col("__chunk") == F.col("__home"))
    if first:
        listed = F.broadcast(hot.frame(df.sparkSession))
        heads = numbered.where("__pos = 1")
        heads = heads.join(listed, null_safe(heads, listed, keys), "left_semi").select(
            *[F.col(k).alias(f"__f_{k}") for k in keys],
            *[F.col(c).alias(f"__v_{n}") for n, c in first.items()],
        )
        cond = F.lit(True)
        for k in keys:
            cond = cond & framed[k].eqNullSafe(heads[f"__f_{k}"])
        local = {f"__l_{n}": F.first_value(c).over(w) for n, c in first.items()}
        framed = framed.withColumns(local).join(F.broadcast(heads), cond, "left")
        framed = framed.withColumns(
            {
                n: F.when(F.col("__home") == 0, F.col(f"__l_{n}")).otherwise(F.col(f"__v_{n}"))
                for n in first
            }
        )
    return framed.select(*df.columns, *columns, *first)


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[Asc],
    column: str,
    out: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Sum of an integer or decimal ``column`` from the partition's start to the row."""
    frame = (Window.unboundedPreceding, Window.currentRow)
    pieces, hot = cut_hot(df, keys, order, rows_per_task)
    if not hot:
        w = Window.partitionBy(*keys).orderBy(*sort_columns(order)).rowsBetween(*frame)
        return df.withColumn(out, F.sum(column).over(w))
    w = Window.partitionBy(*keys, "__piece").orderBy(*sort_columns(order)).rowsBetween(*frame)
    totals = (
        pieces.where("__hot")
        .groupBy(*keys, "__piece")
        .agg(F.sum(column).alias("__s"))
        .withColumn("__before", F.sum("__s").over(_earlier_pieces(keys)))
        .drop("__s")
    )
    local = _with_piece_table(pieces.withColumn("__local", F.sum(column).over(w)), totals, keys)
    total = F.when(
        F.col("__local").isNull() & F.col("__before").isNull(), F.lit(None)
    ).otherwise(F.coalesce("__local", F.lit(0)) + F.coalesce("__before", F.lit(0)))
    return local.select(*df.columns, total.alias(out))


def carry_last(
    df: DataFrame,
    keys: list[str],
    order: list[Asc],
    column: str,
    out: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Latest non-null ``column`` up to and including the row. Order columns ascend and
    are not null."""
    frame = (Window.unboundedPreceding, Window.currentRow)
    pieces, hot = cut_hot(df, keys, order, rows_per_task)
    if not hot:
        w = Window.partitionBy(*keys).orderBy(*sort_columns(order)).rowsBetween(*frame)
        return df.withColumn(out, F.last(column, ignorenulls=True).over(w))
    w = Window.partitionBy(*keys, "__piece").orderBy(*sort_columns(order)).rowsBetween(*frame)
    latest = F.max_by(F.col(column), F.struct(*[o.name for o in order]))
    ends = (
        pieces.where(F.col("__hot") & F.col(column).isNotNull())
        .groupBy(*keys, "__piece")
        .agg(latest.alias("__end"))
    )
    # Pieces without a value still need a row, so that the carry reaches them.
    every = pieces.where("__hot").groupBy(*keys, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    carried = (
        _with_piece_table(every, ends, keys)
        .withColumn("__carry", F.last("__end", ignorenulls=True).over(_earlier_pieces(keys)))
        .drop("__end", "__n")
    )
    local = pieces.withColumn("__local", F.last(column, ignorenulls=True).over(w))
    joined = _with_piece_table(local, carried, keys)
    return joined.select(*df.columns, F.coalesce("__local", "__carry").alias(out))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str,
    time: str,
    value: str,
    out: str,
    tie: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """For each ``left`` row the ``value`` of the latest ``right`` row with the same ``by``
    and ``right.time <= left.time`` (null if none); ``tie`` decides among equal times.

    Both sides are put into one column of rows per key and sorted once, so no pair of rows
    is ever formed: the cost is that of a sort, not of a range join.
    """
    tie = tie or value
    tie_type = right.schema[tie].dataType
    marks = right.where(F.col(time).isNotNull()).select(
        F.col(by).alias("__by"),
        F.col(time).alias("__at"),
        F.lit(0).alias("__side"),
        F.col(tie).alias("__tie"),
        F.struct(F.col(value).alias("v")).alias("__mark"),
    )
    asked = left.where(F.col(time).isNotNull() & F.col(by).isNotNull())
    probes = asked.select(
        F.col(by).alias("__by"),
        F.col(time).alias("__at"),
        F.lit(1).alias("__side"),
        F.lit(None).cast(tie_type).alias("__tie"),
        F.struct(*left.columns).alias("__row"),
    )
    rows = marks.where(F.col("__by").isNotNull()).unionByName(probes, allowMissingColumns=True)
    order = [Asc("__at"), Asc("__side"), Asc("__tie", nulls_first=True)]
    found = carry_last(rows, ["__by"], order, "__mark", "__found", rows_per_task)
    hits = found.where("__side = 1").select("__row.*", F.col("__found.v").alias(out))
    unasked = left.where(F.col(time).isNull() | F.col(by).isNull())
    return hits.unionByName(
        unasked.withColumn(out, F.lit(None).cast(right.schema[value].dataType))
    )


def trailing_count(
    df: DataFrame,
    key: str,
    time: str,
    width: str,
    out: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``count(*) OVER (PARTITION BY key ORDER BY time RANGE BETWEEN width PRECEDING AND
    CURRENT ROW)`` for an interval such as ``INTERVAL 1 DAY``; ``time`` is not null.

    For hot keys it is the running count at the row's time less the running count just
    before ``time - width``, both taken on rows pre-aggregated per key and time.
    """
    if not hot_keys(df, [key], rows_per_task):
        frame = (
            f"count(*) OVER (PARTITION BY `{key}` ORDER BY `{time}` "
            f"RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)"
        )
        return df.withColumn(out, F.expr(frame))
    order = [Asc("__at")]
    times = df.groupBy(F.col(key).alias("__by"), F.col(time).alias("__at")).agg(
        F.count(F.lit(1)).alias("__c")
    )
    upto = running_sum(times, ["__by"], order, "__c", "__upto", rows_per_task)
    # The start of the frame is inclusive, so equal times must not be counted as earlier:
    # the probe sorts ahead of a mark at the same time.
    marks = upto.select("__by", "__at", F.lit(1).alias("__side"), "__upto")
    probes = upto.select(
        "__by",
        F.expr(f"__at - {width}").alias("__at"),
        F.lit(0).alias("__side"),
        F.col("__at").alias("__of"),
        F.col("__upto").alias("__end"),
    )
    rows = marks.unionByName(probes, allowMissingColumns=True)
    early = carry_last(
        rows, ["__by"], [Asc("__at"), Asc("__side")], "__upto", "__early", rows_per_task
    )
    counts = early.where("__side = 0").select(
        "__by",
        "__of",
        (F.col("__end") - F.coalesce("__early", F.lit(0))).alias(out),
    )
    joined = join_unique(df, counts, {key: "__by", time: "__of"}, "left", null_safe=True)
    return joined.select(*df.columns, out)
