"""Helpers the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` names, each lengthened by underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def id_crc(col: Column) -> Column:
    """CRC-32 of an id written as text; null for a null id."""
    return F.crc32(col.cast("string").cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, and of about ``size`` bytes if rows are long."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def no_nulls(column: pa.Array) -> pa.Array:
    """A string column with null as the empty text."""
    return pc.fill_null(column.cast(pa.string()), "")


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a string column, null as the empty text."""
    return no_nulls(column).to_pylist()


# 0-9, a-z and whatever is not ASCII stay, A-Z become a-z; any other byte parts words.
_ALPHANUMERIC = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def alphanumeric_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: longest runs of letters, digits and anything beyond ASCII, A-Z lower-cased."""
    return text.translate(_ALPHANUMERIC).split()
