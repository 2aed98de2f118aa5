"""Delimiter choice for the head of one CSV file."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from itertools import islice

from millrace.functions.infer import DATE_PATTERN, NUMBER_PATTERN, STAMP_PATTERN, YEAR_LAST_PATTERN

# Fixed values.
SAMPLE_CHARS = 4096
SAMPLE_ROWS = 25
DELIMITERS = (",", ";", "\t", "|")
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "iso-8859-1")

_TYPED = re.compile(
    "|".join((YEAR_LAST_PATTERN, NUMBER_PATTERN, DATE_PATTERN, STAMP_PATTERN, "^(?i:true|false)$"))
)


def decode_head(raw: bytes) -> str:
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("no supported encoding: " + ", ".join(ENCODINGS))


def parse(text: str, sep: str, limit: int | None = None):
    """Rows of ``text`` (cells as they stand, any width) with the line each row ends on."""
    csv.field_size_limit(2**31 - 1)
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=sep, quotechar='"')
    for row in islice(reader, limit):
        yield row, reader.line_num


def width_counts(text: str, sep: str) -> Counter:
    rows = (row for row, _ in parse(text, sep, SAMPLE_ROWS))
    return Counter(len(row) for row in rows if len(row) > 1 and any(row))


def dominant(widths: Counter) -> tuple[int, int]:
    """(count, width) of the most common width, the larger one on a tie."""
    return max(((n, w) for w, n in widths.items()), default=(0, 0))


def score(text: str, sep: str) -> tuple[int, int, int]:
    try:
        widths = width_counts(text, sep)
    except csv.Error:
        return (0, 0, 0)
    count, width = dominant(widths)
    return (count, sum(widths.values()), width)


def sniffed(text: str) -> list[str]:
    try:
        return [csv.Sniffer().sniff(text, delimiters="".join(DELIMITERS)).delimiter]
    except csv.Error:
        return []


def _candidates(sample: str) -> list[str]:
    return [d for d in sniffed(sample) if d in DELIMITERS] + list(DELIMITERS)


def choose_delimiter(text: str) -> str:
    """The delimiter with the best score; the sniffed one wins ties, then list order."""
    sample = text[:SAMPLE_CHARS]
    scores = {d: score(sample, d) for d in _candidates(sample)}
    if not any(map(any, scores.values())):
        return DELIMITERS[0]
    return max(scores, key=scores.get)


def _layout(text: str, sep: str, whole: bool) -> dict:
    """How the head looks as a table under ``sep``. Unless it is the whole file, its last
    row may be cut off and is not looked at."""
    rows = list(parse(text, sep, 2 * SAMPLE_ROWS))
    if not whole and len(rows) > 1:
        rows.pop()
    widths = Counter(len(row) for row, _ in rows if len(row) > 1 and any(row))
    _, width = dominant(widths)
    starts = [0] + [end for _, end in rows]
    at = next((i for i, (r, _) in enumerate(rows) if any(r) and len(r) == (width or len(r))), None)
    if at is None:
        return {"width": 0, "skip": 0, "first": [], "rest": [], "even": False}
    rest = [row for row, _ in rows[at + 1 :] if row]
    return {
        "width": width,
        "skip": starts[at],
        "first": rows[at][0],
        "rest": [row for row in rest if len(row) == len(rows[at][0])],
        "even": width > 1 and all(len(row) == width for row in rest),
    }


def describe_head(
    text: str,
    sep: str | None = None,
    whole: bool = True,
    expected: list[tuple[str, list[str]]] | None = None,
) -> dict:
    """Delimiter, width, lines before the table and its first row; ``even`` if the head shows an even table;
    not ``settled`` if it shows none and is not the whole file, where one may then start further down.

    For a load the rows must all be as wide as the first, so a delimiter under which the
    head is an even table comes before one that only scores well, as commas may in prose.
    ``expected`` holds (delimiter, first row) pairs of other files of the same folder: a
    head with such a row is taken to be like them.
    """
    for known, cells in expected or ():
        for i, (row, _) in enumerate(rows := list(parse(text, known, SAMPLE_ROWS))):
            if row == list(cells):
                rest = [r for r, _ in rows[i + 1 :] if len(r) == len(row)]
                return _found(known, rows[i - 1][1] if i else 0, row, rest, True, True)
    if sep is None:
        sample = text[:SAMPLE_CHARS]
        layouts = {d: _layout(text, d, whole) for d in _candidates(sample)}

        def merit(d):
            even = layouts[d]["even"]
            return (even, even and layouts[d]["skip"] == 0, score(sample, d))

        sep = max(layouts, key=merit)
        if not any(x["width"] for x in layouts.values()):
            sep = DELIMITERS[0]
    seen = _layout(text, sep, whole)
    return _found(sep, seen["skip"], seen["first"], seen["rest"], whole or seen["even"], seen["even"])


def has_cells(line: bytes, sep: str, cells: list[str]) -> bool:
    """Whether the line is a row of these cells."""
    if line.count(sep.encode()) < len(cells) - 1:
        return False
    return next((row for row, _ in parse(decode_head(line), sep, 1)), None) == cells


def _found(sep: str, skip: int, first: list[str], rest: list[list[str]], settled: bool, even: bool) -> dict:
    return {
        "sep": sep,
        "n_cols": len(first),
        "skip_rows": skip,
        "first_cells": first,
        "has_header": _is_header(first, rest),
        "settled": settled,
        "even": even,
    }


def _is_header(first: list[str], rest: list[list[str]]) -> bool:
    """A first row is a header unless it fits the types of the rows below it. Where all
    columns are text that cannot be told, and it is taken as one."""
    typed = [
        i
        for i in range(len(first))
        if (cells := [r[i].strip() for r in rest if r[i] != ""]) and all(map(_TYPED.match, cells))
    ]
    return not typed or any(first[i] and not _TYPED.match(first[i].strip()) for i in typed)
