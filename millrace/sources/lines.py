"""Files as numbered lines, and lines as CSV records.

A line frame has ``path``, ``block``, ``pos`` and ``value``; ``(block, pos)`` orders the
lines of a path. Blocks are the byte ranges Spark reads a file in, so work done per block
is bounded by ``spark.sql.files.maxPartitionBytes`` however large the file is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import store

LINE_COLUMNS = ["path", "block", "pos", "value", "sep", "skip"]
# Lines that are kept and cut together, and what of them a task reads at once.
CHUNK_BYTES = 1 << 18
GROUP_BYTES = 1 << 24


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines; ``value`` keeps the file's bytes. Text is split at ``\\n`` only, so a
    ``\\r`` stays at the end of the line."""
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
            "value",
        )
    )


def _after(line: bytes, sep: bytes, inside: int) -> int:
    """1 if the line ends inside a quoted field, given whether it starts inside one.

    A quote opens a field only as its first character; inside, an odd number of quotes in
    the text up to the next separator closes it.
    """
    for piece in line.split(sep):
        if inside or piece.startswith(b'"'):
            inside = (inside + piece.count(b'"')) % 2
    return inside


class _Chunk:
    """Lines of a block that stand together, and the state before and after them for a block that starts
    outside of quotes and for one that starts inside."""

    def __init__(self, path: str, block: int, number: int, sep: str, states: tuple[int, int]):
        self.path, self.block, self.number, self.sep, self.before, self.states = path, block, number, sep, states, states
        self.lines, self.size, self.pos, self.top = [], 0, None, -1

    def add(self, pos: int, line: bytes, sep: bytes) -> None:
        if self.pos is None:
            self.pos = pos
        if self.top < 0 and line not in (b"", b"\r"):
            self.top = len(self.lines)
        if b'"' in line:
            out, other = self.states
            after = _after(line, sep, out)
            self.states = (after, after if out == other else _after(line, sep, other))
        self.lines.append(line)
        self.size += len(line) + 1

    def row(self) -> tuple:
        data = b"\n".join(self.lines)
        return (self.path, self.block, self.number, self.pos, *self.before, *self.states, self.top, self.sep, data)


CHUNK_SCHEMA = (
    "path string, block bigint, chunk bigint, pos bigint, before0 int, before1 int, after0 int, after1 int, "
    "top bigint, sep string, data binary"
)
PART_SCHEMA = "path string, block bigint, pos bigint, whole boolean, starts boolean, top boolean, sep string, record binary"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[field.split()[0] for field in schema.split(", ")])


def _chunks(batches: Iterator[pd.DataFrame], encoding: str, bom: bool) -> Iterator[pd.DataFrame]:
    """Lines, those of a block together and in order, as rows of about ``CHUNK_BYTES``."""
    rows = (row for frame in batches for row in zip(*(frame[c] for c in LINE_COLUMNS)))
    for (path, block), own in groupby(rows, key=lambda row: row[:2]):
        chunk = None
        for at, (_, _, pos, line, mark, skip) in enumerate(own):
            if block == 0 and at < skip:
                continue
            if bom and block == 0 and at == 0:
                line = line.removeprefix(b"\xef\xbb\xbf")
            if chunk is None:
                sep = mark.encode(encoding)
                chunk = _Chunk(path, block, 0, mark, (0, 1))
            elif chunk.size >= CHUNK_BYTES:
                yield _frame([chunk.row()], CHUNK_SCHEMA)
                chunk = _Chunk(path, block, chunk.number + 1, mark, chunk.states)
            chunk.add(pos, line, sep)
        if chunk:
            yield _frame([chunk.row()], CHUNK_SCHEMA)


def _parts(batches: Iterator[pd.DataFrame], encoding: str) -> Iterator[pd.DataFrame]:
    """Records that lie within a chunk, and the parts there of others."""
    rows = (row for frame in batches for row in frame.itertuples(index=False, name=None))
    for path, block, pos, inside, top, mark, data in rows:
        sep, out, lines = mark.encode(encoding), [], data.split(b"\n")
        at, starts = 0, not inside
        for i, line in enumerate(lines):
            if b'"' in line:
                inside = _after(line, sep, inside)
            if inside:
                continue
            record = line if at == i else b"\n".join(lines[at : i + 1])
            out.append((path, block, pos + at, starts, starts, at == top, mark, record.removesuffix(b"\r")))
            at, starts = i + 1, True
        if at < len(lines):
            out.append((path, block, pos + at, False, starts, at == top, mark, b"\n".join(lines[at:])))
        yield _frame(out, PART_SCHEMA)


def records(lines: DataFrame, in_order: bool = False, encoding: str = "utf-8", bom: bool = False) -> DataFrame:
    """Line frame with ``sep`` and ``skip`` (first lines to drop) per row → one row per CSV
    record: ``path, block, pos, record, sep, top`` in the position of its first line; ``top`` marks
    the first of its path that is not empty. ``in_order``: a task has the lines of its blocks as the
    files have them. ``bom``: the files begin with a byte order mark, which is dropped.

    Whether a line starts inside quotes depends on all lines before it. Lines are written once as
    chunks, with the map from the state before the block to that at the chunk's ends; the blocks'
    own maps (one row each) are run through in order per file. Then every chunk is cut by itself,
    and only the parts of records that lie in several are brought together.
    """
    given = lines.select("path", "block", "pos", F.col("value").cast("binary").alias("value"), "sep", "skip")
    if not in_order:
        given = given.repartition("path", "block").sortWithinPartitions("path", "block", "pos")
    made = given.mapInPandas(lambda batches: _chunks(batches, encoding, bom), CHUNK_SCHEMA)
    chunks = store(made, "lines", {"parquet.block.size": str(GROUP_BYTES)})

    # A block sets the state, keeps it or flips it.
    blocks = chunks.groupBy("path", "block").agg(
        F.max(F.col("chunk") * 4 + F.col("after0") * 2 + F.col("after1")).alias("__last")
    )
    after0, after1 = F.floor(F.col("__last") / 2) % 2, F.col("__last") % 2
    by_file = Window.partitionBy("path").orderBy("block")
    through = by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flip = F.when((after0 == 1) & (after1 == 0), 1).otherwise(0)
    starts = (
        blocks.withColumn("__all", F.sum(flip).over(through))
        .withColumn("__v", F.when(after0 == after1, (after0 + F.col("__all")) % 2))
        .withColumn("__base", F.last("__v", ignorenulls=True).over(through))
        .withColumn("__end", (F.coalesce("__base", F.lit(0)) + F.col("__all")) % 2)
        .select("path", "block", F.coalesce(F.lag("__end").over(by_file), F.lit(0)).alias("__in"))
    )
    tops = chunks.where("top >= 0").groupBy("path").agg(F.min(F.struct("block", "chunk")).alias("__top"))
    # One row per block and per file, which Spark lists on the driver for any read.
    placed = chunks.join(F.broadcast(starts), ["path", "block"]).join(F.broadcast(tops), "path", "left")
    first = F.struct("block", "chunk") == F.col("__top")
    ready = placed.select(
        "path",
        "block",
        "pos",
        F.when(F.col("__in") == 1, F.col("before1")).otherwise(F.col("before0")).alias("inside"),
        F.when(first, F.col("top")).otherwise(-1).alias("top"),
        "sep",
        "data",
    )
    parts = ready.mapInPandas(lambda batches: _parts(batches, encoding), PART_SCHEMA)
    whole = parts.where("whole").drop("whole", "starts")

    upto = Window.partitionBy("path").orderBy("block", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.last(F.when(F.col("starts"), F.struct("block", "pos")), ignorenulls=True).over(upto)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "pos", "record"))), lambda p: p.getField("record"))
    text = F.array_join(F.transform(pieces, lambda p: p.cast("string")), "\n")
    grouped = (
        parts.where("NOT whole")
        .withColumn("__rec", begun)
        .groupBy("path", "__rec", "sep")
        .agg(F.regexp_replace(text, r"\r$", "").cast("binary").alias("record"), F.bool_or("top").alias("top"))
    )
    both = whole.unionByName(grouped.select("path", "__rec.block", "__rec.pos", "top", "sep", "record"))
    return both.withColumn("record", F.col("record").cast("string"))
