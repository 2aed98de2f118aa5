"""Values in the form a JSON client can show.

Integers, booleans and strings stay; non-finite floats become ``"NaN"``, ``"Infinity"``
and ``"-Infinity"``; decimals become strings; dates and times ISO-8601; intervals seconds;
bytes UTF-8 text or else hex; nested values JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.names import quote

PLAIN = (T.BooleanType, T.StringType, T.IntegralType, T.NullType)


def iso_stamp(c: Column) -> Column:
    """ISO-8601; the fraction only when there is one, then six digits."""
    micros = F.date_format(c, "SSSSSS")
    fraction = F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), fraction)


def iso_time(c: Column) -> Column:
    text = c.cast("string")
    whole, fraction = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    padded = F.concat(whole, F.lit("."), F.rpad(fraction, 6, "0"))
    return F.when(F.contains(text, F.lit(".")), padded).otherwise(text)


def seconds(c: Column) -> Column:
    parts = (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))
    total = F.lit(0).cast("double")
    for unit, size in parts:
        total = total + F.extract(F.lit(unit), c).cast("double") * size
    return total


def not_finite(c: Column) -> Column:
    return F.isnan(c) | c.isin(float("inf"), float("-inf"))


def safe_column(c: Column, kind: T.DataType) -> Column:
    """``c`` as boolean, integer, double or string. A float column that may hold
    non-finite values is text; ``json_rows`` keeps its finite values as numbers."""
    if isinstance(kind, PLAIN):
        return c
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.cast("string")
    if isinstance(kind, T.TimestampNTZType):
        return iso_stamp(c)
    if isinstance(kind, T.TimestampType):
        return _zoned_text(c)
    if isinstance(kind, T.TimeType):
        return iso_time(c)
    if isinstance(kind, T.DayTimeIntervalType):
        return seconds(c)
    if isinstance(kind, T.BinaryType):
        text = c.cast("string")
        return F.when(F.is_valid_utf8(text), text).otherwise(F.lower(F.hex(c)))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def _zoned_text(c: Column) -> Column:
    """A zoned timestamp as text with the session zone's offset."""
    return F.concat(c.cast("string"), F.date_format(c, "x"))


def json_safe(df: DataFrame) -> DataFrame:
    """Same rows and names, every value in its client form."""
    cols = [safe_column(F.col(quote(f.name)), f.dataType).alias(f.name) for f in df.schema]
    return df.select(*cols)


def _fragment(c: Column, kind: T.DataType) -> Column:
    """One value as a JSON text fragment."""
    if isinstance(kind, T.NullType):
        return F.lit("null")
    value = safe_column(c, kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        quoted = F.concat(F.lit('"'), value, F.lit('"'))
        text = F.when(not_finite(c), quoted).otherwise(value)
    else:
        listed = F.to_json(F.array(value))
        text = F.substring(listed, F.lit(2), F.length(listed) - 2)
    return F.when(c.isNull(), "null").otherwise(text)


def json_rows(df: DataFrame, out: str = "row") -> DataFrame:
    """One JSON array text per row, values in column order."""
    parts = [_fragment(F.col(quote(f.name)), f.dataType) for f in df.schema]
    return df.select(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")).alias(out))


def as_text(df: DataFrame) -> DataFrame:
    """Every column cast to text."""
    return df.select(*[F.col(quote(c)).cast("string").alias(c) for c in df.columns])
