"""Column types from text, over every value.

Each value is put into one class; a column's classes are or-ed into a bit mask, which is a
partial aggregate of one number per column. The type follows from the mask alone, so one
late odd value anywhere in the data keeps a column text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.names import quote

BOOL, INT, HUGE, DOUBLE, DATE, STAMP, ZONED, TIME, TEXT = (1 << i for i in range(9))

# Dates with the year last: per separator a class for those that only make sense with the day first, only
# with the month first, and either way.
SEPARATORS = ("/", "-", ".")
DAY_FIRST, MONTH_FIRST, EITHER = ({s: 1 << (9 + 3 * i + k) for i, s in enumerate(SEPARATORS)} for k in range(3))

INT_PATTERN = r"^[+-]?(0|[1-9]\d*)$"
NUMBER_PATTERN = r"^[+-]?((0|[1-9]\d*)(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
DATE_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}$"
STAMP_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"
ZONED_PATTERN = STAMP_PATTERN[:-1] + r" ?(Z|[+-]\d{2}(:?\d{2})?)$"
YEAR_LAST_PATTERN = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})$"
TIME_PATTERN = r"^\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"

BOOL_WORDS = ("true", "false", "t", "f")
DOUBLE_WORDS = ("nan", "inf", "infinity", "+inf", "-inf", "+infinity", "-infinity")

# Smallest type first: the column takes the first type that covers all classes seen.
COVERS = (
    (BOOL, "boolean"),
    (INT, "bigint"),
    (INT | HUGE, "decimal(38,0)"),
    (INT | HUGE | DOUBLE, "double"),
    (DATE, "date"),
    (DATE | STAMP, "timestamp_ntz"),
    (DATE | STAMP | ZONED, "timestamp"),
    (TIME, "time"),
    *((EITHER[s] | DAY_FIRST[s], "date day first") for s in SEPARATORS),
    *((EITHER[s] | MONTH_FIRST[s], "date month first") for s in SEPARATORS),
)
# What a type is called here, and how its text is put into the order of ISO dates.
ORDERS = {"date day first": "$4-$3-$1", "date month first": "$4-$1-$3"}


def _year_last_class(v: Column) -> Column:
    """Class bit of a date with the year last; null if it is no day of the calendar either way."""
    day, month = (
        F.regexp_replace(v, YEAR_LAST_PATTERN, ORDERS[k]).try_cast("date").isNotNull()
        for k in ("date day first", "date month first")
    )
    bits = None
    for s in SEPARATORS:
        own = F.when(day & month, EITHER[s]).when(day, DAY_FIRST[s]).when(month, MONTH_FIRST[s])
        here = F.contains(v, F.lit(s))
        bits = F.when(here, own) if bits is None else bits.when(here, own)
    return bits


def value_class(c: Column) -> Column:
    """The class bit of a text value; null for null. A flat chain, each pattern once."""
    v = F.trim(c)
    # A failing try_cast costs as much as dozens of matches: only values that may be out of
    # range are tried.
    whole = (
        F.when((F.octet_length(v) < 19) | v.try_cast("bigint").isNotNull(), INT)
        .when(v.try_cast("decimal(38,0)").isNotNull(), HUGE)
        .otherwise(DOUBLE)
    )
    return (
        F.when(c.isNull(), F.lit(None).cast("int"))
        .when(v.rlike(INT_PATTERN), whole)
        .when(v.rlike(NUMBER_PATTERN) | F.lower(v).isin(*DOUBLE_WORDS), DOUBLE)
        .when(F.lower(v).isin(*BOOL_WORDS), BOOL)
        .when(v.rlike(DATE_PATTERN) & v.try_cast("date").isNotNull(), DATE)
        .when(v.rlike(STAMP_PATTERN) & v.try_cast("timestamp_ntz").isNotNull(), STAMP)
        .when(v.rlike(ZONED_PATTERN) & v.try_cast("timestamp").isNotNull(), ZONED)
        .when(v.rlike(TIME_PATTERN) & v.try_cast("time").isNotNull(), TIME)
        .when(v.rlike(YEAR_LAST_PATTERN), F.coalesce(_year_last_class(v), F.lit(TEXT)))
        .otherwise(TEXT)
    )


def type_of(mask: int | None) -> str:
    if not mask:
        return "string"
    return next((name for covered, name in COVERS if mask & ~covered == 0), "string")


def masks(df: DataFrame) -> list[int | None]:
    """Class mask per column of an all-text frame, in one pass.

    The columns are turned into rows first, so that the class expression is compiled once
    whatever the number of columns; what is shuffled is one number per column and task.
    """
    cells = df.select(F.posexplode(F.array(*[F.col(quote(c)) for c in df.columns])))
    bits = cells.groupBy("pos").agg(F.bit_or(value_class(F.col("col"))).alias("mask"))
    found = {r["pos"]: r["mask"] for r in bits.collect()}
    return [found.get(i) for i in range(len(df.columns))]


def infer_types(df: DataFrame) -> list[str]:
    return [type_of(m) for m in masks(df)]


def typed(c: Column, kind: str) -> Column:
    """Text to ``kind``; the class check has made sure that it casts. Dates with the year last become dates
    by the order that fits the whole column; where every value fits both, the day comes first."""
    if kind in ORDERS:
        return F.regexp_replace(F.trim(c), YEAR_LAST_PATTERN, ORDERS[kind]).cast("date")
    return c if kind == "string" else F.trim(c).cast(kind)


def cast_all(df: DataFrame, kinds: list[str]) -> DataFrame:
    cols = [typed(F.col(quote(c)), k).alias(c) for c, k in zip(df.columns, kinds)]
    return df.select(*cols)
