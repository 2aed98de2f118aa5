"""Where a file's table starts, however many lines of notes are ahead of it.

The table is the longest run of records of one width that reaches the end of the file. Each block of lines is
summed up by itself: its last even run, whether that is all of it, and what is open at its ends. Whether a block
starts inside a quoted cell is only known from the blocks before it, so it is summed up both ways; a file's
blocks, a few rows each, are then run through in order. Nothing is bounded to a number of lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

from millrace.functions.dialect import DELIMITERS

RUN_SCHEMA = (
    "path string, block bigint, sep string, inside boolean, lines bigint, width bigint, n bigint, at bigint, "
    "whole boolean, lead bigint, closed boolean, open_at bigint, open_seps bigint"
)
TABLE_SCHEMA = "path string, sep string, skip bigint, n bigint"


def scan(line: bytes, sep: bytes, inside: bool) -> tuple[int, bool]:
    """Separators of ``line`` outside quoted cells, and whether it ends inside one. A quote opens a cell only
    as its first character."""
    if b'"' not in line:
        return (0, True) if inside else (line.count(sep), False)
    count, pieces = 0, line.split(sep)
    for i, piece in enumerate(pieces):
        if inside or piece.startswith(b'"'):
            inside = (inside + piece.count(b'"')) % 2 == 1
        count += i < len(pieces) - 1 and not inside
    return count, inside


@dataclass
class Run:
    """A block of lines under one separator, started inside a quoted cell or not.

    ``width, n, at``: of its last even run of records that start and end in it; ``whole``: that is all of them.
    ``lead``: separators of the record that was open before, ``closed`` if it ends here. ``open_at`` (-1 if none)
    and ``open_seps``: of the record still open at the end.
    """

    inside: bool
    lines: int = 0
    width: int = 0
    n: int = 0
    at: int = -1
    whole: bool = True
    lead: int = 0
    closed: bool = False
    open_at: int = -1
    open_seps: int = 0

    def __post_init__(self):
        self._in, self._leading = self.inside, self.inside

    def add(self, line: bytes, sep: bytes) -> None:
        here, self.lines = self.lines, self.lines + 1
        if not self._in and line in (b"", b"\r"):
            return
        started = not self._in
        seps, self._in = scan(line, sep, self._in)
        if self._leading:
            self.lead += seps
            if not self._in:
                self._leading, self.closed = False, True
            return
        if started:
            self.open_at, self.open_seps = here, 0
        self.open_seps += seps
        if not self._in:
            self.record(self.open_seps + 1, self.open_at)
            self.open_at = -1

    def record(self, width: int, at: int, n: int = 1) -> None:
        if n and width == self.width:
            self.n += n
        elif n:
            self.whole = self.n == 0
            self.width, self.n, self.at = width, n, at


_FIELDS = [f.name for f in fields(Run)]


def _summaries(batches: Iterator[pd.DataFrame], seps: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    rows = (row for frame in batches for row in zip(frame["path"], frame["block"], frame["value"]))
    for (path, block), own in groupby(rows, key=lambda r: r[:2]):
        # The first block starts outside.
        runs = [(s, s.encode(), Run(inside)) for s in seps for inside in ((False, True) if block else (False,))]
        for _, _, line in own:
            line = bytes(line)
            for _, sep, run in runs:
                run.add(line, sep)
        out = [(path, block, sep, *astuple(run)) for sep, _, run in runs]
        yield pd.DataFrame(out, columns=["path", "block", "sep", *_FIELDS])


def joined(runs: list[Run]) -> Run:
    """A file's blocks in order, both ways each, as one."""
    whole, inside, open_at, seps = Run(False), False, -1, 0
    by_block = iter(runs)
    for pair in by_block:
        run = next(r for r in pair if r.inside == inside)
        if inside:
            seps += run.lead
            if run.closed:
                whole.record(seps + 1, open_at)
        if run.n and run.whole:
            whole.record(run.width, whole.lines + run.at, run.n)
        elif run.n:
            whole.width, whole.n, whole.at, whole.whole = run.width, run.n, whole.lines + run.at, False
        if run.open_at >= 0:
            inside, open_at, seps = True, whole.lines + run.open_at, run.open_seps
        elif inside and run.closed:
            inside = False
        whole.lines += run.lines
    return whole


def tables(lines: DataFrame, sep: str | None = None) -> DataFrame:
    """``path, sep, skip, n`` of every file of a line frame that ends in an even table: its separator, lines
    ahead of it and records. Of several separators it is that of most records, then of most columns."""
    seps = (sep,) if sep else DELIMITERS
    given = lines.selectExpr("path", "block", "pos", "cast(value AS binary) AS value")
    ordered = given.repartition("path", "block").sortWithinPartitions("path", "block", "pos")
    summed = ordered.mapInPandas(lambda batches: _summaries(batches, seps), RUN_SCHEMA)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for s in seps:
            own = frame[frame["sep"] == s].sort_values("block")
            blocks = [
                [Run(*[v.item() if hasattr(v, "item") else v for v in row]) for row in b[_FIELDS].itertuples(index=False)]
                for _, b in own.groupby("block")
            ]
            run = joined(blocks)
            if run.width > 1 and run.n > 1:
                found.append((run.n, run.width, -seps.index(s), s, run.at))
        path = frame["path"].iloc[0]
        rows = [(path, s, at, n) for n, _, _, s, at in [max(found)]] if found else []
        return pd.DataFrame(rows, columns=["path", "sep", "skip", "n"])

    return summed.groupBy("path").applyInPandas(choose, TABLE_SCHEMA)
