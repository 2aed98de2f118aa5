"""CSV export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import storage
from millrace.names import quote

CSV_WRITE = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def csv_text(df: DataFrame) -> DataFrame:
    """Columns in the text form a CSV cell takes; plain numbers and strings stay as they are."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(quote(f.name)), f.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = _stamp_text(c)
        elif isinstance(kind, T.BinaryType):
            c = F.base64(c)
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(kind, (T.TimeType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def _stamp_text(c):
    """``yyyy-MM-dd HH:mm:ss`` with as many fraction digits as the value has."""
    return c.cast("timestamp_ntz").cast("string")


def export_csv(
    df: DataFrame, path: str, single_file: bool = False, sep: str = ",", encoding: str = "UTF-8"
) -> str:
    """Write ``df`` as CSV: under ``path`` a part per partition, each with a header, or with ``single_file`` one
    file ``path`` of all rows with one header, in the order of the partitions.

    The rows of a single file are written by as many tasks as there are partitions, side by side, and the file
    system then joins the parts. A failure leaves no file and no parts; an existing file is an error.
    """
    text = csv_text(df)
    options = CSV_WRITE | {"sep": sep, "encoding": encoding}
    if not single_file:
        text.write.options(**options).csv(path)
        return path
    spark = df.sparkSession
    if storage.exists(spark, path):
        raise FileExistsError(path)
    parts = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex[:12]}"
    try:
        head = spark.createDataFrame([tuple(df.columns)], ", ".join(f"c{i} string" for i in range(len(df.columns))))
        head.coalesce(1).write.options(**options | {"header": "false"}).csv(f"{parts}/head")
        text.write.options(**options | {"header": "false"}).csv(f"{parts}/body")
        pieces = [f"{parts}/{d}/{n}" for d in ("head", "body") for n in sorted(storage.names(spark, f"{parts}/{d}")) if n.startswith("part-")]
        storage.join(spark, pieces, f"{parts}/whole")
        if not storage.rename(spark, f"{parts}/whole", path):
            raise FileExistsError(path)
    finally:
        storage.remove(spark, parts)
    return path
