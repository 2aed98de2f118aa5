"""CSV files to typed tables: profile, text preview, typed read.

All files under a path are handled as one job. A file that Spark's own reader parses as it
stands goes through it, split by byte ranges. A file with lines ahead of its header, or with
line breaks in quoted cells that is large (Spark's reader gives it to a single task) or holds a
carriage return (which Spark's reader takes out of cells), is read as numbered lines that are
put together to records first (``sources/lines.py``), so it too is read by many tasks. Both
ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import charset, infer
from millrace.functions.dialect import (
    SAMPLE_CHARS,
    SAMPLE_ROWS,
    choose_delimiter,
    decode_head,
    describe_head,
    has_cells,
    parse,
)
from millrace.names import dedupe, default_names
from millrace.session import store
from millrace.sources import even_runs, heads
from millrace.sources.heads import Tops
from millrace.sources.lines import records, text_lines

PREVIEW_LIMIT = 100

# Up to this size a file with line breaks in quoted cells and no carriage return is parsed whole by one task.
WHOLE_FILE_BYTES = 64 * 1024 * 1024

HEAD_SCHEMA = (
    "path string, sep string, n_cols int, skip_rows int, has_header boolean, "
    "first_cells array<string>, settled boolean, even boolean"
)
PREVIEW_SCHEMA = "path string, pos int, cells array<string>, truncated boolean"


@dataclass(frozen=True)
class Dialect:
    """What is known of the files beforehand; ``None`` is found out by reading them."""

    sep: str | None = None
    encoding: str | None = None
    header: bool | None = None
    skip_rows: int | None = None
    multiline: bool | None = None

    def complete(self) -> bool:
        return None not in (self.sep, self.encoding, self.header)


# --- per-file facts --------------------------------------------------------------------


def _file_facts(lines: DataFrame) -> DataFrame:
    """Encoding and quoting per file from all of its bytes: a partial aggregate, JVM only."""
    raw = F.col("value")
    valid = charset.is_utf8(raw)
    quotes = F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit('"')))
    undefined = F.when(~valid, charset.latin1(raw).rlike(charset.CP1252_UNDEFINED))
    mark = F.hex(F.substring(raw.cast("binary"), 1, 3)) == "EFBBBF"
    facts = lines.groupBy("path").agg(
        F.bool_and(valid).alias("__utf8"),
        F.coalesce(F.bool_or(undefined), F.lit(False)).alias("__undefined"),
        F.bool_or(quotes % 2 == 1).alias("multiline"),
        # One number, so that the lines need not be sorted by path: place and mark of the first line.
        F.min(F.when(F.col("block") == 0, 2 * F.col("pos") + mark.cast("bigint"))).alias("__first"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.octet_length(raw) + 1).alias("n_bytes"),
        F.bool_or(F.contains(raw, F.lit("\r"))).alias("carriage"),
    )
    encoding = (
        F.when(F.col("__utf8"), charset.UTF8)
        .when(~F.col("__undefined"), charset.CP1252)
        .otherwise(charset.LATIN1)
    )
    bom = F.coalesce(F.col("__first") % 2 == 1, F.lit(False))
    kept = ["n_lines", "n_bytes", "carriage"]
    return facts.select("path", encoding.alias("encoding"), "multiline", bom.alias("bom"), *kept)


def _heads(tops: Tops, sep: str | None, expected) -> DataFrame:
    def describe(path, lines):
        taken, size, whole = [], 0, True
        for line in lines:
            if size >= SAMPLE_CHARS and len(taken) > SAMPLE_ROWS:
                whole = False
                break
            taken.append(line)
            size += len(line) + 1
        found = describe_head(decode_head(b"\n".join(taken)), sep, whole, expected)
        if expected and not found["even"]:
            found = _further_down(chain(taken, lines if whole else chain([line], lines)), expected) or found
        return pd.DataFrame([{"path": path, **found}])

    return tops.each(describe, HEAD_SCHEMA)


def _further_down(lines: Iterator[bytes], expected) -> dict | None:
    """The head of a file whose notes are followed by a row other files of its folder begin with, at any depth."""
    for at, line in enumerate(lines):
        if any(has_cells(line, known, cells) for known, cells in expected):
            found = describe_head(decode_head(b"\n".join([line, *islice(lines, SAMPLE_ROWS)])), None, False, expected)
            return {**found, "skip_rows": found["skip_rows"] + at}
    return None


def profile_lines(lines: DataFrame, tops: Tops, sep: str | None = None, expected=None) -> DataFrame:
    return _file_facts(lines).join(_heads(tops, sep, expected), "path")


def _deepened(lines: DataFrame, profile: DataFrame, sep: str | None) -> DataFrame:
    """``profile`` with the files looked at whole whose heads show no even table: where the table that
    reaches the file's end starts, and its first row from there."""
    own = lines.join(profile.where("NOT settled").select("path"), "path", "left_semi")
    found = store(even_runs.tables(own, sep), "even-runs")
    start = found.select("path", F.col("sep").alias("__sep"), F.col("skip").alias("__skip"))
    top = own.where("block = 0").join(start, "path").repartition("path").sortWithinPartitions("path", "pos")
    top = top.select("path", F.col("value").cast("binary").alias("value"), "__sep", "__skip")

    def describe(batches):
        rows = (row for frame in batches for row in frame.itertuples(index=False, name=None))
        for path, run in groupby(rows, key=lambda row: row[0]):
            taken, size = [], 0
            for at, (_, line, known, skip) in enumerate(run):
                if at >= skip and (size < SAMPLE_CHARS or len(taken) <= SAMPLE_ROWS):
                    taken.append(bytes(line))
                    size += len(taken[-1]) + 1
            if taken:
                head = describe_head(decode_head(b"\n".join(taken)), known, False)
                yield pd.DataFrame([{"path": path, **head, "skip_rows": head["skip_rows"] + skip, "settled": True, "even": True}])

    deep = top.mapInPandas(describe, HEAD_SCHEMA)
    names = [f.split()[0] for f in HEAD_SCHEMA.split(", ")][1:]
    better = deep.select("path", *[F.col(n).alias(f"__{n}") for n in names])
    merged = profile.join(store(better, "deep-heads"), "path", "left")
    for n in names:
        chosen = F.when(F.col("__settled"), F.col(f"__{n}")).otherwise(F.col(n))
        merged = merged.withColumn(n, F.lit(True) if n == "settled" else chosen)
    return merged.drop(*[f"__{n}" for n in names])


def profile_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: path, encoding, multiline, bom, n_lines, n_bytes, sep, n_cols,
    skip_rows, has_header, first_cells. Encoding and multiline come from the whole file, the
    delimiter from its first 4,096 characters, or from the whole file if they show no even table."""
    lines = text_lines(spark, path)
    found = store(profile_lines(lines, heads.of_files(spark, path, lines)), "profile")
    if not found.where("NOT settled").isEmpty():
        found = _deepened(lines, found, None)
    return found.drop("settled", "even", "carriage")


def preview_tops(tops: Tops, limit: int = PREVIEW_LIMIT) -> DataFrame:
    if not 1 <= limit <= PREVIEW_LIMIT:
        raise ValueError(f"limit must be between 1 and {PREVIEW_LIMIT}")

    def rows_of(run) -> list[list[str]]:
        taken, size, check = [], 0, limit + 1
        for line in run:
            taken.append(line)
            size += len(line) + 1
            if len(taken) >= check and size >= SAMPLE_CHARS:
                rows = cut(taken)
                if len(rows) > limit + 1:
                    return rows
                check = 2 * len(taken)
        return cut(taken)

    def cut(taken):
        # One row more than asked for shows that there is more; a last row that may still
        # go on in the next line is only trusted when another one follows it.
        text = decode_head(b"\n".join(taken))
        return [row for row, _ in parse(text, choose_delimiter(text), limit + 2)]

    def preview(path, lines):
        rows = rows_of(lines)
        shown = {"path": path, "pos": range(min(len(rows), limit)), "cells": rows[:limit]}
        return pd.DataFrame(shown | {"truncated": len(rows) > limit})

    return tops.each(preview, PREVIEW_SCHEMA)


def preview_lines(lines: DataFrame, limit: int = PREVIEW_LIMIT, in_order: bool = True) -> DataFrame:
    return preview_tops(heads.of_lines(lines, in_order), limit)


def preview_csv_text(
    spark: SparkSession, path: str | list[str], limit: int = PREVIEW_LIMIT
) -> DataFrame:
    """The first ``limit`` rows of each file as text cells of any width: path, pos, cells,
    truncated. Nothing is skipped, typed or padded, and no more is read than that takes."""
    return preview_tops(heads.of_files(spark, path, text_lines(spark, path)), limit)


# --- typed read ------------------------------------------------------------------------


@dataclass(frozen=True)
class _Group:
    """Files that can be parsed alike."""

    encoding: str
    sep: str
    n_cols: int
    skip_rows: int
    multiline: bool
    bom: bool
    by_lines: bool
    first: tuple[str, ...]
    one_first_row: bool
    files: int
    settled: bool = True
    even: bool = True


_KEYS = ["encoding", "sep", "n_cols", "skip_rows", "multiline", "bom", "by_lines"]


def _with_way(profile: DataFrame) -> DataFrame:
    by_lines = F.col("multiline") & (F.col("carriage") | (F.col("n_bytes") > WHOLE_FILE_BYTES))
    return profile.withColumn("by_lines", by_lines)


def _groups(profile: DataFrame, dialect: Dialect) -> list[_Group]:
    for field in ("encoding", "skip_rows", "multiline"):
        if getattr(dialect, field) is not None:
            profile = profile.withColumn(field, F.lit(getattr(dialect, field)))
    rows = (
        _with_way(profile)
        .groupBy(*_KEYS)
        .agg(
            F.min("first_cells").alias("lo"),
            F.max("first_cells").alias("hi"),
            F.count(F.lit(1)).alias("files"),
            F.bool_and("settled").alias("settled"),
            F.bool_or("even").alias("even"),
        )
        .collect()
    )
    if not rows:
        raise FileNotFoundError("no CSV file with any line")
    return [
        _Group(*[r[k] for k in _KEYS], tuple(r["lo"]), r["lo"] == r["hi"], r["files"], r["settled"], r["even"])
        for r in rows
    ]


def _profiled(lines: DataFrame, tops: Tops, dialect: Dialect, expected) -> tuple[DataFrame, list[_Group]]:
    profile = profile_lines(lines, tops, dialect.sep, expected)
    groups = _groups(profile, dialect)
    if dialect.skip_rows is None and not all(g.settled for g in groups):
        profile = _deepened(lines, profile, dialect.sep)
        groups = _groups(profile, dialect)
    return profile, groups


def _csv_options(sep: str) -> dict:
    return {
        "sep": sep,
        "quote": '"',
        "escape": '"',
        "mode": "FAILFAST",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }


def _text_schema(n: int) -> str:
    return ", ".join(f"c{i} string" for i in range(n))


def _all_columns(df: DataFrame, change) -> DataFrame:
    return df.select(*[change(F.col(c)).alias(c) for c in df.columns])


def _read_plain(spark, paths, group: _Group, header: bool) -> DataFrame:
    charset_name = "UTF-8" if group.encoding == charset.UTF8 else "ISO-8859-1"
    df = (
        spark.read.schema(_text_schema(group.n_cols))
        .options(**_csv_options(group.sep), encoding=charset_name, header=header)
        .option("multiLine", group.multiline)
        .csv(paths)
    )
    # Folder names like key=value would add columns the files do not have.
    df = df.select(*[f"c{i}" for i in range(group.n_cols)])
    return _all_columns(df, charset.as_cp1252) if group.encoding == charset.CP1252 else df


def _records(lines: DataFrame, group: _Group, in_order: bool) -> DataFrame:
    """The group's records, put together once: they are read for the types and again for
    the rows."""
    marked = lines.select(
        "path",
        "block",
        "pos",
        "value",
        F.lit(group.sep).alias("sep"),
        F.lit(group.skip_rows).alias("skip"),
    )
    found = records(marked, in_order, group.encoding, group.bom and group.encoding == charset.UTF8)
    text = charset.decode_line(F.col("record"), F.lit(group.encoding))
    # Empty lines are no records; a line of blanks is one, as it is to the other reader.
    return found.where(F.col("record") != "").select(text.alias("record"), "top")


def _read_records(rows: DataFrame, group: _Group, header: bool) -> DataFrame:
    if header:
        rows = rows.where("NOT top")
    options = _csv_options(group.sep) | {"multiLine": "true"}
    cells = F.from_csv(F.col("record"), F.lit(_text_schema(group.n_cols)), options)
    return rows.select(cells.alias("__cells")).select("__cells.*")


def _combine(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def type_table(read_rows, firsts: list[tuple], header: bool | None, one_first_row: bool):
    """Shared by CSV and workbooks. ``read_rows(header)`` gives the text rows with or
    without the first row of each file; returns the typed table.

    The first row is a header unless it fits the types of all other rows; where every
    column is text it is one, if all files begin with it.
    """
    first = firsts[0]
    body = read_rows(header is not False)
    found = infer.masks(body)
    if header is None:
        spark = body.sparkSession
        top = spark.createDataFrame([tuple(c or None for c in first)], _text_schema(len(first)))
        own = infer.masks(top)
        both = [(a or 0) | (b or 0) for a, b in zip(found, own)]
        kinds = [infer.type_of(m) for m in found]
        if all(k == "string" for k in kinds):
            header = one_first_row and len(set(firsts)) == 1
        else:
            header = any(
                k != "string" and infer.type_of(m) != k for k, m in zip(kinds, both)
            )
        if not header:
            body, found = read_rows(False), both
    if header and not (one_first_row and len(set(firsts)) == 1):
        raise ValueError("the files do not share one header row")
    names = dedupe(list(first)) if header else default_names(len(first))
    kinds = [infer.type_of(m) for m in found]
    typed = infer.cast_all(body, kinds)
    return typed.toDF(*names)


def _blank_as_null(df: DataFrame) -> DataFrame:
    return _all_columns(df, lambda c: F.nullif(c, F.lit("")))


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    dialect: Dialect | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Typed rows of the CSV files under ``path``.

    Without ``dialect`` each file's encoding, delimiter, header and preamble are found
    out; without ``schema`` the column types come from every value. Given both, the files
    are read in a single pass. Empty cells are null. A row of another width than the
    header is an error.
    """
    dialect = dialect or Dialect()
    if dialect.complete() and schema and not dialect.skip_rows and not dialect.multiline:
        return _read_known(spark, path, dialect, schema)
    return read_csv_lines(text_lines(spark, path), dialect, schema, plain_path=path)


def _read_known(spark, path, dialect: Dialect, schema: str) -> DataFrame:
    fields = spark.createDataFrame([], schema).schema.fields
    group = _Group(dialect.encoding, dialect.sep, len(fields), 0, False, False, False, (), True, 0)
    text = _blank_as_null(_read_plain(spark, path, group, dialect.header))
    kinds = [f.dataType.simpleString() for f in fields]
    return infer.cast_all(text, kinds).toDF(*[f.name for f in fields])


def read_csv_lines(
    lines: DataFrame,
    dialect: Dialect | None = None,
    schema: str | None = None,
    plain_path: str | list[str] | None = None,
) -> DataFrame:
    """Typed rows of a line frame. ``plain_path`` names the files it came from, if they
    can be handed to Spark's CSV reader."""
    spark = lines.sparkSession
    dialect = dialect or Dialect()
    if plain_path is None:
        tops = heads.of_lines(lines, False)
    else:
        tops = heads.of_files(spark, plain_path, lines)
    profile, groups = _profiled(lines, tops, dialect, None)
    if len({g.first for g in groups}) > 1 or not all(g.one_first_row for g in groups):
        # Some heads may have been misread: see whether the commonest first rows are in them.
        # Files without an even table (notes and a header alone, say) do not tell what it looks like.
        shared = [g for g in groups if g.one_first_row]
        shared = [g for g in shared if g.even] or shared
        top = max((g.files for g in shared), default=0)
        expected = [(g.sep, list(g.first)) for g in shared if 2 * g.files > top]
        profile, groups = _profiled(lines, tops, dialect, expected)
    widths = {g.n_cols for g in groups}
    if len(widths) > 1:
        raise ValueError(f"the files differ in their number of columns: {sorted(widths)}")

    located = []
    for g in groups:
        if len(groups) == 1:
            located.append((g, plain_path, lines))
            continue
        mine = profile
        for field in ("encoding", "skip_rows", "multiline"):
            if getattr(dialect, field) is not None:
                mine = mine.withColumn(field, F.lit(getattr(dialect, field)))
        mine = _with_way(mine)
        for k in _KEYS:
            mine = mine.where(F.col(k) == F.lit(getattr(g, k)))
        if plain_path:
            # Paths only, as many as Spark lists on the driver for any read.
            files = [unquote(r["path"]) for r in mine.select("path").collect()]
            located.append((g, files, text_lines(spark, files)))
        else:
            located.append((g, None, lines.join(mine.select("path"), "path", "left_semi")))

    kept: dict[_Group, DataFrame] = {}

    def read_rows(header: bool) -> DataFrame:
        frames = []
        for g, files, own_lines in located:
            if g.skip_rows or g.by_lines or not files or (g.bom and not header):
                if g not in kept:
                    kept[g] = _records(own_lines, g, plain_path is not None)
                frames.append(_read_records(kept[g], g, header))
            else:
                frames.append(_read_plain(spark, files, g, header))
        return _blank_as_null(_combine(frames))

    if schema:
        fields = spark.createDataFrame([], schema).schema.fields
        header = dialect.header is not False
        kinds = [f.dataType.simpleString() for f in fields]
        return infer.cast_all(read_rows(header), kinds).toDF(*[f.name for f in fields])
    firsts = [g.first for g in groups]
    return type_table(read_rows, firsts, dialect.header, all(g.one_first_row for g in groups))
