"""Mixing sources to target weights, on DataFrame functions alone.

Tokens are summed per source, each source gets a target, and its repetition rate is target over
size. A document is then emitted floor(rate) times, plus once more with the fraction as its
probability, decided by a hash of seed, id and text, so a rerun or a retried task decides alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import WORD, fresh, quoted
from millrace.session import store

#: Weights dealt to the sources in order of their names, again from the first when used up.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS
) -> DataFrame:
    """One row per source of ``sizes(source, size)``: ``source, source_size, target, rate``.

    ``share`` times all words is dealt out by weight. A source takes at most ``most`` times its own
    size; what it cannot take goes to the others by weight. With the sources sorted by the level
    ``most * size / weight`` at which each is full, those up to some point are full and the others
    stand at one common level, which running sums give. Sources that are empty have target 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # One row per source here: what the windows below see is the number of sources, not of rows.
    named = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]),
        ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"),
    )
    full = F.col("source_size") * F.lit(float(most))
    per = per.withColumn("weight", dealt).withColumn("full_at", full / F.col("weight"))
    levels = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = levels.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("full_size", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("full_weight", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # The level if exactly the sources before this one were full. It holds from the first source that it does
    # not fill; taking later ones for full as well only lowers it, so that is the largest one that holds.
    level = (F.col("total") * F.lit(float(share)) - F.col("full_size") * F.lit(float(most))) / (
        F.col("all_weight") - F.col("full_weight")
    )
    per = per.withColumn("level", level)
    open_level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
    per = per.withColumn("open_level", open_level)
    target = F.when(
        F.col("open_level").isNull() | (F.col("full_at") < F.col("open_level")), full
    ).otherwise(F.col("weight") * F.col("open_level"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("target", target).select(
        "source", "source_size", "target", rate.alias("rate")
    )


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on nothing but the seed, the id and the text (null: the text "null").
    Ids may be missing or repeat; only rows equal in both are drawn alike."""
    known = [F.coalesce(c, F.lit("null")) for c in (doc_id.cast("string"), F.md5(text.cast("binary")))]
    key = F.concat_ws(":", F.lit(str(seed)), *known)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def copies(rate: Column, drawn: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(drawn < rate - whole, 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of every row of ``docs(doc_id, text, source)``.

    Null texts have size 0; a null source is a source of its own, last in order; rows of one doc_id
    and text are drawn alike; an empty table gives no rows. A text's length does not matter.
    """
    # The draw is made here: texts do not go through the join.
    sizes = docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        draw(F.col("doc_id"), F.col("text"), seed).alias("drawn"),
    )
    # The stored table has one row per source. Its measured size decides whether the join below
    # sends it to every task or shuffles (with the hot source then split by adaptive execution).
    per = store(targets(sizes.select("source", "size"), **options), "mix-targets")
    per = per.withColumnRenamed("source", "of_source")
    return sizes.join(per, F.col("source").eqNullSafe(F.col("of_source")), "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies(F.col("rate"), F.col("drawn")).alias("copies"),
    )


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; the columns stay as they are."""
    of_source, rate, every = fresh(docs, "of_source", "mix_rate", "mix_copy")
    sizes = docs.select(quoted("source").alias("source"), word_count(quoted("text")).alias("size"))
    per = store(targets(sizes, **options), "mix-targets").select(
        F.col("source").alias(of_source), F.col("rate").alias(rate)
    )
    taken = docs.join(per, quoted("source").eqNullSafe(F.col(of_source)), "left").withColumn(
        every, F.explode(F.array_repeat(F.lit(1), copies(F.col(rate), draw(quoted("doc_id"), quoted("text"), seed)).cast("int")))
    )
    return taken.select(*[quoted(c) for c in docs.columns])


def mixed(docs: DataFrame) -> DataFrame:
    """The digest of the mix of ``docs``, a row per row."""
    return plan_mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(md5(text), 'null') AS digest, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM p),
l AS (SELECT *, source_size * 2.0::DOUBLE / weight AS full_at FROM w),
r AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
  coalesce(sum(source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
  coalesce(sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_weight FROM l),
v AS (SELECT *, (total * 1.5::DOUBLE - full_size * 2.0::DOUBLE) / (all_weight - full_weight) AS level FROM r),
o AS (SELECT *, max(level) FILTER (WHERE level <= full_at) OVER () AS open_level FROM v),
t AS (SELECT source, source_size, CASE WHEN open_level IS NULL OR full_at < open_level THEN source_size * 2.0::DOUBLE
  ELSE weight * open_level END AS target FROM o),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || digest), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
