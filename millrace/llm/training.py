"""Labelled rows for the classifiers of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_crc, quoted


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows that no model may learn from; false for a null id."""
    return F.coalesce(F.pmod(id_crc(doc_id), F.lit(folds)) == fold, F.lit(False))


def _learnable(labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """``of_doc, y``, a row per document labelled 0 or 1 (with its largest label) that is not held out."""
    return (
        labels.select(F.col("doc_id").alias("of_doc"), F.col(label).cast("int").alias("y"))
        .filter(F.col("of_doc").isNotNull() & F.col("y").isin(0, 1))
        .filter(~held_out(F.col("of_doc"), folds, fold))
        .groupBy("of_doc")
        .agg(F.max("y").alias("y"))
    )


def class_counts(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int) -> dict[int, int]:
    """How many rows of ``docs`` each class has to learn from, those beyond the sample of ``labelled`` too.

    Only ids are read and shuffled; rows of a repeated id are counted before they meet its label.
    """
    per_id = docs.groupBy(quoted("doc_id").alias("doc_id")).agg(F.count("*").alias("n"))
    known = per_id.join(_learnable(labels, label, folds, fold), F.col("doc_id") == F.col("of_doc"))
    found = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    return {y: found.get(y, 0) for y in (0, 1)}


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: dict[int, int]
) -> DataFrame:
    """``y, text`` of documents labelled in ``labels(doc_id, label)``, none of them held out.

    At most ``most[y]`` labels of each class y are used, those with the least hashes of their id, so the
    list of ids is small enough to send to every task, and no text is shuffled. A document labelled
    more than once counts with its largest label; null ids and labels other than 0 and 1 do not count.
    """
    rows = _learnable(labels, label, folds, fold)
    chosen = None
    for y, n in most.items():
        part = rows.filter(F.col("y") == y).orderBy(F.xxhash64("of_doc"), "of_doc").limit(n)
        chosen = part if chosen is None else chosen.union(part)
    return docs.select(quoted("doc_id").alias("doc_id"), quoted("text").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("of_doc")
    ).select("y", "text")
