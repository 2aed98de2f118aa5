"""Best-fit packing of token sequences, in bulk-synchronous rounds over runs of equal lengths.

Pieces of one length are interchangeable, and so are gaps of one size; lengths are whole numbers up to the
capacity. Range-sorted by length, all pieces are therefore at most ``capacity`` runs, however many rows
there are, counted where the rows are. A round takes the longest run that is left and sweeps the sorted
gaps upwards from its length: the successor gap run takes as many pieces as it has gaps, conflicts being
resolved by rank (piece number i of the run goes to gap number i), the gaps shrink, and the sweep goes on
until the run is placed; what fits no gap opens new sequences. That is best-fit-decreasing over all pieces.
The outcome, per run a list of rank ranges and where they go, is as small as the runs; the rows themselves
never meet: each looks its own rank up, in parallel.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import no_nulls, slices
from millrace.llm.token_memo import (
    LONGEST,
    PARTS,
    Memo,
    cut,
    is_word,
    parts_of,
    spell,
    tokenizer,
)
from millrace.session import store

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
END = 2
_memos: dict[str, Memo] = {}


def _memo(path: str) -> Memo:
    if path in _memos:
        return _memos[path]
    tok = tokenizer(path)
    merge = tok.model.tokenize
    parts: dict[str, bytes] = {}

    def encode(stretches: list[str]) -> list[bytes]:
        if len(parts) > PARTS:
            parts.clear()
        cut_up = [parts_of(s) for s in stretches]
        others = []
        for part in {p for c in cut_up for p in c if p not in parts}:
            if is_word(part.removeprefix(" ")):
                parts[part] = array("I", [t.id for t in merge(spell(part))]).tobytes()
            else:
                others.append(part)
        for part, e in zip(others, tok.encode_batch_fast(others, add_special_tokens=False)):
            parts[part] = array("I", e.ids).tobytes()
        out = [b"".join([parts[p] for p in c]) for c in cut_up]
        for part in others:
            if len(part) > LONGEST:
                del parts[part]
        return out

    return _memos.setdefault(path, Memo(cut, encode))


def pieces(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end: int = END,
    keep_ids: bool = False,
) -> DataFrame:
    """The pieces of ``docs(doc_id, text)``: ``doc_id, piece, start, length, ids_crc32, task, nth[, ids]``.

    A document's ids are the library's, then ``end``; null texts are empty. Documents of more than
    ``capacity`` ids are cut, the first piece being the short one. ``nth`` numbers the pieces of one length
    within a task.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    last = np.array([end], "<u4").tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, task, seen = _memo(path), TaskContext.get().partitionId(), Counter()
        for batch in slices(batches):
            rows = {k: [] for k in ("row", "piece", "start", "length", "crc", "nth", "ids")}
            flat, ends = memo.of(no_nulls(batch.column(1)))
            for row, ids in enumerate(np.split(flat, ends[:-1])):
                ids = ids.tobytes() + last
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    stop = start + ((n - start - 1) % capacity + 1 if piece == 0 else capacity)
                    part = ids[4 * start : 4 * stop]
                    values = (row, piece, start, stop - start, zlib.crc32(part), seen[stop - start], part)
                    for column, value in zip(rows.values(), values):
                        column.append(value)
                    seen[stop - start] += 1
                    start, piece = stop, piece + 1
            columns = [
                batch.column(0).take(pa.array(rows["row"], pa.int64())),
                pa.array(rows["piece"], pa.int32()),
                *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc")),
                pa.array([task] * len(rows["row"]), pa.int32()),
                pa.array(rows["nth"], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            if keep_ids:
                flat = np.frombuffer(b"".join(rows["ids"]), "<u4").astype(np.int32)
                ends = np.cumsum([0, *rows["length"]]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.select("doc_id").schema.fields[0].dataType.simpleString()
    more = ", ids array<int>" if keep_ids else ""
    return docs.select("doc_id", "text").mapInArrow(
        split,
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long{more}",
    )


def rounds(runs: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit-decreasing of ``runs`` (length -> pieces): ``(length, first rank, pieces, first sequence, offset)``.

    Sequences that are filled alike stay one run of consecutive numbers. A run of gaps that is not used up
    by a run of pieces is split in two, so the result has a few entries per length.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of (first sequence, sequences)
    sizes: list[int] = []  # sizes of open gaps, sorted
    placed, made = [], 0

    def open_gap(size: int, first: int, n: int) -> None:
        if size > 0 and n > 0:
            if size not in gaps:
                bisect.insort(sizes, size)
            gaps.setdefault(size, []).append((first, n))

    for length in sorted((k for k in runs if runs[k]), reverse=True):
        rank, left = 0, runs[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                # No successor: as many new sequences as the rest fills, then one for what is left over.
                n = max(left // (capacity // length), 1)
                open_gap(capacity, made, n)
                made += n
                continue
            size = sizes[at]
            first, n = gaps[size].pop()
            if not gaps[size]:
                del gaps[size]
                sizes.pop(at)
            take = min(n, left)
            placed.append((length, rank, take, first, capacity - size))
            rank, left = rank + take, left - take
            open_gap(size - length, first, take)
            open_gap(size, first + take, n - take)
    return placed


def pack(spark: SparkSession, parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (stored rows of ``pieces``) with ``sequence_id`` and ``offset``.

    A piece's rank among those of its length is its number within its task plus the pieces of that length
    in earlier tasks. No group of equal lengths is gathered anywhere: tasks send one count per length.
    """
    per_task = parts.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = store(
        per_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-ranks"
    )
    runs = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # Starts of the rank ranges of every length, as sorted arrays: a row finds its own by its rank.
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, rank, n, sequence, offset in rounds(runs, capacity):
        plan.setdefault(length, []).append((rank, n, sequence, offset))
    schema = "length long, ranges array<struct<first:long,n:long,sequence:long,offset:long>>"
    ranges = spark.createDataFrame(list(plan.items()), schema)  # a row per length: at most ``capacity``
    ranked = (
        parts.join(base.select("length", "task", "before"), ["length", "task"])
        .withColumn("rank", F.col("before") + F.col("nth"))
        .drop("before", "nth", "task")
        .join(F.broadcast(ranges), "length")
    )
    own = F.element_at(
        F.filter("ranges", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["n"])), 1
    )
    return (
        ranked.withColumn("own", own)
        .withColumn("sequence_id", F.col("own.sequence") + F.col("rank") - F.col("own.first"))
        .withColumn("offset", F.col("own.offset"))
        .drop("ranges", "own", "rank")
    )


def packed(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every piece of every row of ``docs`` with its place. The pieces are stored first, so that ranks stay
    what they are when a task runs again. Repeated rows are packed each; an empty table gives no rows."""
    parts = store(pieces(docs, capacity=capacity, keep_ids=keep_ids), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = pack(docs.sparkSession, parts, capacity)
    return done.select(*columns, *(["ids"] if keep_ids else []))
