"""First lines of files, without reading the rest of them.

A task opens the files it is given and reads block after block until whoever looks at the lines has seen
enough. Only names go through Spark, so the work is that of the files' number, not of their size. Spark's
text reader would have to go through every byte, since lines far down cannot be told from the first ones
before they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain, groupby
from urllib.parse import unquote, urlparse

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.programs import lines_of

BLOCK = 1 << 14
# Names of files that Spark's readers unpack.
PACKED = r"(?i)\.(gz|gzip|bz2|zst|zstd|lz4|snappy|deflate)$"
# File systems by the names Spark's users give them and those they have here.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "hdfs": "hdfs", "gs": "gs", "s3": "s3"}


@dataclass(frozen=True)
class Tops:
    """``runs`` makes (path, its lines as bytes, in order) out of the batches of ``frame`` in a task. Lines
    that are not asked for need not be there."""

    frame: DataFrame
    runs: Callable[[Iterator[pd.DataFrame]], Iterator[tuple[str, Iterator[bytes]]]]

    def each(self, describe: Callable[[str, Iterator[bytes]], pd.DataFrame], schema: str) -> DataFrame:
        """What ``describe(path, lines)`` says of every file."""
        runs = self.runs

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for path, lines in runs(batches):
                yield describe(path, lines)

        return self.frame.mapInPandas(work, schema)


@contextmanager
def opened(path: str):
    """The file at a path as ``_metadata.file_path`` gives it, open for reading blocks."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        with open(unquote(at.path), "rb", buffering=0) as file:
            yield file
    else:
        where, name = fs.FileSystem.from_uri(unquote(path.replace(at.scheme, SCHEMES[at.scheme], 1)))
        with where.open_input_stream(name, buffer_size=0) as file:
            yield file


def lines_in(file) -> Iterator[bytes]:
    """Lines of an open file; a block is read when the lines of the one before have been taken."""
    blocks = iter(lambda: file.read(BLOCK), b"")
    return chain.from_iterable(lines_of(blocks, BLOCK))


def _in_files(batches: Iterator[pd.DataFrame]):
    for frame in batches:
        for path in frame["path"]:
            with opened(path) as file:
                yield path, lines_in(file)


def _in_rows(batches: Iterator[pd.DataFrame]):
    pairs = ((p, v) for frame in batches for p, v in zip(frame["path"], frame["value"]))
    for path, run in groupby(pairs, key=lambda pair: pair[0]):
        yield path, (bytes(v) for _, v in run)


def of_lines(lines: DataFrame, in_order: bool) -> Tops:
    """Lines of the first block of each path. Lines read from a text file are in order within a task;
    stored lines have to be brought together."""
    top = lines.where("block = 0")
    if not in_order:
        top = top.repartition("path").sortWithinPartitions("path", "pos")
    return Tops(top.select("path", F.col("value").cast("binary").alias("value")), _in_rows)


def _can_open(path: str) -> bool:
    try:
        with opened(path) as file:
            file.read(1)
    except (OSError, KeyError, ValueError, ImportError):
        return False
    return True


def of_files(spark: SparkSession, path: str | list[str], lines: DataFrame) -> Tops:
    """The files under ``path``, which the tasks open. Packed files, and file systems that only Spark's
    readers can open, are read as ``lines``."""
    listed = spark.read.format("binaryFile").load(path)
    files = listed.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    files = files.where("size > 0")
    seen = files.agg(F.min("path").alias("one"), F.bool_or(F.col("path").rlike(PACKED)).alias("packed")).first()
    if seen["one"] is None or seen["packed"] or not _can_open(seen["one"]):
        return of_lines(lines, True)
    return Tops(files.select("path"), _in_files)
