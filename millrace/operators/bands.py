"""Band joins that return rows: each point with the first band it falls in.

The values are cut into pieces of about as many points, at sampled values. A band goes to the pieces it reaches
into, and a piece that one value makes large is dealt out further by chance, its bands with it. In a piece the bands
are swept once in the order of their bounds: between two neighbouring bounds the first of the open bands is the
same for all points, so points only look up between which bounds they lie. No point meets a band.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.names import quote
from millrace.operators.hot import ROWS_PER_TASK
from millrace.session import store

MAX_PIECES = 1_000


def first_open(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For bands ``[low, high)`` in order of preference: the distinct bounds, and which band is the first that
    holds the values from each bound to the next (-1: none)."""
    bounds = np.unique(np.concatenate([low, high]))
    first = np.full(len(bounds), -1)
    starts = np.argsort(low, kind="stable")
    open_: list[int] = []
    at = 0
    for i, bound in enumerate(bounds):
        while at < len(starts) and low[starts[at]] <= bound:
            heapq.heappush(open_, int(starts[at]))
            at += 1
        while open_ and high[open_[0]] <= bound:
            heapq.heappop(open_)
        if open_:
            first[i] = open_[0]
    return bounds, first


def band_join(
    points: DataFrame,
    bands: DataFrame,
    value: str,
    low: str,
    high: str,
    prefer: list[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every row of ``points`` with the columns of the band with ``low <= value < high`` that comes first by
    ``prefer``, columns that tell the bands apart; nulls where there is none.

    Values and bounds are compared as doubles. Null and NaN values fall in no band; bands with a null bound or
    without an extent hold nothing. Columns of the two tables must differ in name.
    """
    spark = points.sparkSession
    at, from_, to = (F.col(quote(c)).cast("double") for c in (value, low, high))
    keyed = store(points.withColumn("__at", F.when(~F.isnan(at), at)), "band-points")
    inside = keyed.where("__at IS NOT NULL")
    pieces = min(MAX_PIECES, 1 + inside.count() // rows_per_task)
    shares = [i / pieces for i in range(1, pieces)]
    cuts = inside.agg(F.percentile_approx("__at", shares, 10_000)).first()[0] if shares else []
    cuts = sorted(set(cuts or []))
    marks = F.array(*[F.lit(c) for c in cuts])
    piece_of = lambda c: F.size(F.filter(marks, lambda m: m <= c)) if cuts else F.lit(0)

    placed = inside.withColumn("__piece", piece_of(F.col("__at")))
    # A row per piece: how many parts it is dealt out to.
    sizes = {r["__piece"]: r["count"] for r in placed.groupBy("__piece").count().collect()}
    dealt = [(p, -(-n // (2 * rows_per_task))) for p, n in sizes.items()] or [(0, 1)]
    parts = lambda: F.broadcast(spark.createDataFrame(dealt, "__piece int, __parts long"))
    spread = placed.join(parts(), "__piece").withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "__parts"))

    # The bands in order of preference, as far as they reach into pieces.
    whole = bands.where((from_ < to) & ~F.isnan(to)).withColumns({"__low": from_, "__high": to})
    # The last piece that has values below the upper bound.
    last = F.size(F.filter(marks, lambda m: m < F.col("__high"))) if cuts else F.lit(0)
    reach = whole.withColumn("__piece", F.explode(F.sequence(piece_of(F.col("__low")), last)))
    reach = reach.join(parts(), "__piece").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    point_columns, band_columns = points.columns, bands.columns
    out = [*points.schema.fields, *bands.schema.fields]
    ordering = list(prefer)

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        band = right.to_pandas() if right.num_rows else None
        if band is None:
            found = np.full(left.num_rows, -1)
            chosen = right.select(band_columns)
        else:
            order = band.sort_values(ordering, kind="stable").index.to_numpy()
            bounds, first = first_open(band["__low"].to_numpy()[order], band["__high"].to_numpy()[order])
            slot = np.searchsorted(bounds, left.column("__at").to_numpy(), side="right") - 1
            found = np.where(slot >= 0, first[np.maximum(slot, 0)], -1)
            chosen = right.select(band_columns).take(pa.array(order))
        index = pa.array(found, pa.int64(), mask=found < 0)
        taken = chosen.take(index) if chosen.num_rows else pa.table({f.name: pa.nulls(left.num_rows, f.type) for f in chosen.schema})
        both = left.select(point_columns)
        for name in band_columns:
            both = both.append_column(name, taken.column(name))
        return both

    keys = ["__piece", "__part"]
    schema = ", ".join(f"{quote(f.name)} {f.dataType.simpleString()}" for f in out)
    matched = spread.groupBy(*keys).cogroup(reach.groupBy(*keys)).applyInArrow(match, schema)
    nowhere = keyed.where("__at IS NULL").select(
        *[F.col(quote(c)) for c in point_columns],
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in bands.schema.fields],
    )
    return matched.unionByName(nowhere)
