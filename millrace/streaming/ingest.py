"""Growing a table from a directory that files keep arriving in."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import storage
from millrace.functions.charset import UTF8
from millrace.names import quote
from millrace.session import store
from millrace.sources.csv import Dialect, profile_csv, read_csv

BATCH = "__batch"


def ingest_csv(
    spark: SparkSession,
    source_dir: str,
    target_dir: str,
    checkpoint_dir: str,
    schema: str,
    sep: str = ",",
    header: bool = True,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Append the rows of all files not taken in yet, then stop. Returns the whole table.

    Which files were taken in is kept in ``checkpoint_dir``, and the parquet sink lists the
    files of finished batches only, so a run that was cut off is simply run again: each
    file's rows end up in the table once. A file whose header names other columns than
    ``schema``, or in another order, is an error and not read by position.
    """
    reader = spark.readStream.schema(schema).options(
        header=header,
        sep=sep,
        escape='"',
        mode="FAILFAST",
        enforceSchema="false",
        ignoreLeadingWhiteSpace="false",
        ignoreTrailingWhiteSpace="false",
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.csv(source_dir)
    blanks = [
        F.nullif(F.col(quote(f.name)), F.lit("")).alias(f.name)
        if f.dataType.simpleString() == "string"
        else F.col(quote(f.name))
        for f in rows.schema
    ]
    query = (
        rows.select(*blanks)
        .writeStream.format("parquet")
        .option("path", target_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(target_dir)


def _by_header(spark: SparkSession, paths: list[str], fields) -> DataFrame:
    """Rows of these files, whose headers hold the names of ``fields`` in any order."""
    profile = store(profile_csv(spark, paths), "arrived")
    alike = ["sep", "encoding", "skip_rows", "multiline", "has_header", "first_cells"]
    kinds = {f.name: f.dataType.simpleString() for f in fields}
    frames = []
    for kind in profile.groupBy(*alike).agg(F.collect_list("path").alias("paths")).collect():
        header = [(cell or "").strip() for cell in kind["first_cells"]]
        if sorted(header) != sorted(kinds):
            raise ValueError(f"the columns of {kind['paths'][0]} are {header}, not {list(kinds)}")
        schema = ", ".join(f"{quote(n)} {kinds[n]}" for n in header)
        dialect = Dialect(kind["sep"], kind["encoding"] or UTF8, True, kind["skip_rows"], kind["multiline"])
        rows = read_csv(spark, [unquote(p) for p in kind["paths"]], dialect, schema)
        frames.append(rows.select(*map(quote, kinds)))
    out = frames[0] if frames else spark.createDataFrame([], ", ".join(f"{quote(n)} {k}" for n, k in kinds.items()))
    for more in frames[1:]:
        out = out.unionAll(more)
    return out


def ingest_files(
    spark: SparkSession,
    source_dir: str,
    target_dir: str,
    checkpoint_dir: str,
    schema: str,
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """``ingest_csv`` for files of unknown encoding, delimiter, preamble and order of columns.

    Each batch of new files is profiled, its files are read by the names in their headers, and its rows
    become the part of the table that carries the batch's number. A batch that was cut off runs again under
    the same number and replaces its part, so each file's rows are in the table once. A file whose header
    names other columns than ``schema`` is an error, and none of its batch is added; a file without any line
    adds nothing. What the driver holds of a batch is its paths, ``max_files_per_trigger`` at most.
    """
    fields = spark.createDataFrame([], schema).schema.fields

    def take(arrived: DataFrame, number: int) -> None:
        paths = [r["path"] for r in arrived.collect()]
        if paths:
            rows = _by_header(arrived.sparkSession, paths, fields)
            rows.write.mode("overwrite").parquet(f"{target_dir}/{BATCH}={number}")

    query = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(source_dir)
        .select("path")
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not storage.names(spark, target_dir):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(target_dir).select(*[quote(f.name) for f in fields])
