"""Pages of a stored table in the order it is stored in, without a sort key.

A parquet table's rows have a place: their file and their row in it. Files come by time, then name, so rows
added later come later. How many rows each file has is in its footer; the running sums of these counts are
kept next to the table, a row per file. A page then reads the files it lies in and no others, and the total
reads nothing but the sums.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import storage
from millrace.names import quote
from millrace.operators.preview import PAGE_ROWS

_INDEX = "file string, first bigint, n bigint"


def _index_path(spark: SparkSession, path: str) -> str:
    """Where the sums of the files there are now would be: a name no reader of the table looks at."""
    files = sorted(spark.read.parquet(path).inputFiles())
    return f"{path.rstrip('/')}/_positions-{hashlib.sha256(chr(10).join(files).encode()).hexdigest()[:24]}"


def positions(spark: SparkSession, path: str) -> DataFrame:
    """``file, first, n``: the place of each file's first row and its rows. Made once for a set of files:
    the scan for it reads no column, only footers."""
    kept = _index_path(spark, path)
    if not storage.complete(spark, kept):
        rows = spark.read.parquet(path)
        meta = rows.metadataColumn("_metadata")
        counts = rows.groupBy(
            meta["file_path"].alias("file"), meta["file_modification_time"].alias("at")
        ).agg(F.count(F.lit(1)).alias("n"))
        # A row per file: the one window over all of them is small.
        before = Window.orderBy("at", "file").rowsBetween(Window.unboundedPreceding, -1)
        first = F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))
        counts.select("file", first.alias("first"), "n").write.mode("overwrite").parquet(kept)
    return spark.read.schema(_INDEX).parquet(kept)


def stored_total(spark: SparkSession, path: str) -> int:
    """Rows of the table, from the kept sums."""
    return positions(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def stored_page(
    spark: SparkSession, path: str, offset: int = 0, limit: int = PAGE_ROWS, position: str | None = None
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the parquet table at ``path``, in stored order; the same on every
    call while the table stays as it is, and the earlier pages stay when rows are added. ``position`` names a
    column for the row's place, if wanted."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    within = (F.col("first") < offset + limit) & (F.col("first") + F.col("n") > offset)
    found = positions(spark, path).where(within).orderBy("first").collect()  # the files of one page
    whole = spark.read.parquet(path)
    if not found:
        none = whole.where("false")
        return none.withColumn(position, F.lit(0).cast("bigint")) if position else none
    rows = spark.read.schema(whole.schema).parquet(*[r["file"] for r in found])
    meta = rows.metadataColumn("_metadata")
    starts = F.create_map(*[F.lit(x) for r in found for x in (r["file"], r["first"])])
    place = starts[meta["file_path"]] + meta["row_index"]
    name = position or "__place"
    placed = rows.withColumn(name, place).where((F.col(quote(name)) >= offset) & (F.col(quote(name)) < offset + limit))
    ordered = placed.orderBy(quote(name))
    return ordered if position else ordered.drop(name)
