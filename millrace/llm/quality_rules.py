"""Quality rules with adaptive limits, on DataFrame functions alone.

Each document statistic is put into a histogram of integer buckets, 128 to each power of two. Such a
histogram is a quantile sketch: a value read from it is off by at most 1/128, its size does not grow
with the rows, and two are merged by adding counts, in any order and with the same result. One is kept
per language and source; those with few documents are merged into their language's, and those into one
of all. A document is then joined with the limits its group's quantiles give.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import WORD, fresh, quoted
from millrace.session import store



class Limit(NamedTuple):
    """Between the quantiles ``lower`` and ``upper`` (percent) of a group lies its spread, at least one
    bucket. Values up to ``reach`` spreads above the upper one are kept, and in any case those up to
    ``least``; with ``both`` values more than ``reach`` spreads below the lower one are not."""

    lower: int
    upper: int
    reach: int
    least: int = 0
    both: bool = False


#: Characters per thousand words, symbols and repeated words per million words, repeated lines per million lines.
#: Most documents have few symbols and repeats, so their upper quantiles are further out. ``least`` is a
#: tenth: it decides only in groups nearly all of whose documents have none.
STATISTICS = {
    "word_length": Limit(25, 75, reach=5, both=True),
    "symbol_rate": Limit(50, 90, reach=4, least=100_000),
    "line_rate": Limit(50, 99, reach=1, least=100_000),
    "repeat_rate": Limit(50, 95, reach=6, least=100_000),
}
#: Binary digits of a value that its bucket keeps.
DIGITS = 8
#: With fewer documents a group takes its language's limits, and a language those of all.
LEAST_DOCS = 200
SYMBOLS = "[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lines(text: Column) -> Column:
    """How many lines have a word, and how many of them equal an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    counted = lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup"))
    return let(lines, counted)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by 3-word windows that the text has twice or more."""
    keys = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(keys: Column) -> Column:
        # Equal windows side by side, then the first word of each that has an equal neighbour.
        sides = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, j: (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"]),
            )
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        # A window covers three words, or those up to the next such window's first.
        def total(p: Column) -> Column:
            steps = F.transform(
                p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))
            )
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(sides, starts), total)

    def checked(keys: Column) -> Column:
        # Most texts repeat nothing: a hash set of plain numbers settles those without the sort.
        alike = F.size(F.array_distinct(keys)) == F.size(keys)
        return F.when(alike, F.lit(0)).otherwise(covered(keys))

    return F.when(n < 4, F.lit(0)).otherwise(let(keys, checked))


def measure(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with the statistics of ``text`` (null: no words), the base rules and the rates.

    Added columns: ``MEASURES``, ``base_failed`` and the rates of ``STATISTICS``, each named with ``prefix``.
    """
    text = F.coalesce(quoted("text"), F.lit(""))

    # One expression, in which the words are split off once; the optimizer may move it but not unfold it.
    def all_of(w: Column) -> Column:
        n = F.size(w)
        return let(_lines(text), lambda lines: numbers(w, n, lines))

    def numbers(w: Column, n: Column, lines: Column) -> Column:
        named = {
            "n_words": n,
            "word_chars": F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
            "n_symbols": F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
            "n_dup_lines": lines["dup"],
            "n_repeat_words": _repeat_words(w, n),
            "n_lines": lines["n"],
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in named.items()])

    (stats,) = fresh(docs, "statistics_of_text")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    split = docs.withColumn(stats, let(words, all_of))
    counted = split.withColumns({prefix + k: quoted(stats)[k] for k in (*MEASURES, "n_lines")}).drop(stats)
    c = {k: quoted(prefix + k) for k in (*MEASURES, "n_lines")}

    def rate(x: str, per: str, scale: int) -> Column:
        return F.call_function("div", c[x] * scale, F.greatest(c[per], F.lit(1).cast("long")))

    return counted.withColumns(
        {
            prefix + "base_failed": (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"]),
            prefix + "word_length": rate("word_chars", "n_words", 1_000),
            prefix + "symbol_rate": rate("n_symbols", "n_words", 1_000_000),
            prefix + "line_rate": rate("n_dup_lines", "n_lines", 1_000_000),
            prefix + "repeat_rate": rate("n_repeat_words", "n_words", 1_000_000),
        }
    )


def bucket(value: Column) -> Column:
    """The least number of the bucket of a whole number >= 0: its first binary digits, then zeros."""
    digits = F.length(F.bin(value))
    drop = F.greatest(digits - DIGITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame, prefix: str = "") -> DataFrame:
    """``level, lang, source, statistic, bucket, n``: level 2 per language and source, 1 per language, 0 all.

    Documents that fail the base rules are not counted. Rows are counted where they are read, so a
    source with a third of all rows sends no more than the others.
    """
    values = F.array(
        *[F.struct(F.lit(s).alias("statistic"), bucket(quoted(prefix + s)).alias("bucket")) for s in STATISTICS]
    )
    # Not a filter: that would be moved below the measuring and measure once more.
    each = F.explode(F.when(~quoted(prefix + "base_failed"), values)).alias("e")
    rows = measured.select(quoted("lang").alias("lang"), quoted("source").alias("source"), each)
    fine = store(
        rows.groupBy("lang", "source", "e.statistic", "e.bucket").agg(F.count("*").alias("n")), "sketch"
    )
    nothing = F.lit(None).cast("string")
    lang = fine.groupBy("lang", "statistic", "bucket").agg(F.sum("n").alias("n"))
    whole = fine.groupBy("statistic", "bucket").agg(F.sum("n").alias("n"))
    return (
        fine.select(F.lit(2).alias("level"), "lang", "source", "statistic", "bucket", "n")
        .unionByName(lang.select(F.lit(1).alias("level"), "lang", nothing.alias("source"), "statistic", "bucket", "n"))
        .unionByName(
            whole.select(
                F.lit(0).alias("level"), nothing.alias("lang"), nothing.alias("source"), "statistic", "bucket", "n"
            )
        )
    )


def limits(sketch: DataFrame) -> DataFrame:
    """A row per level, language and source with ``low_*`` and ``high_*`` of every statistic, and ``n``:
    what ``STATISTICS`` says of the group's quantiles (bucket starts)."""
    keys = ["level", "lang", "source", "statistic"]
    window = Window.partitionBy(*keys)
    running = F.sum("n").over(window.orderBy("bucket"))
    ranked = sketch.withColumn("upto", running).withColumn("all", F.sum("n").over(window))
    wanted = sorted({q for s in STATISTICS.values() for q in (s.lower, s.upper)})
    quantile = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("bucket")))
    per = ranked.groupBy(*keys).agg(F.max("all").alias("n"), *[quantile(q).alias(f"q{q}") for q in wanted])
    out = []
    for name, limit in STATISTICS.items():
        own = lambda q, name=name: F.max(F.when(F.col("statistic") == name, F.col(f"q{q}")))
        low, high = own(limit.lower), own(limit.upper)
        spread = F.greatest(high - low, F.shiftright(high, DIGITS - 1)) * limit.reach
        out.append(F.greatest(high + spread, F.lit(limit.least).cast("long")).alias("high_" + name))
        out.append((low - spread if limit.both else F.lit(0).cast("long")).alias("low_" + name))
    return per.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *out)


def group_limits(measured: DataFrame, prefix: str = "") -> DataFrame:
    """The limits that hold for each language and source of ``measured``, a stored table.

    A group of under ``LEAST_DOCS`` counted documents has its language's limits, and with too few of
    the language those of all documents (which are taken however few they are).
    """
    levels = store(limits(sketches(measured, prefix)), "limits")
    names = [p + s for s in STATISTICS for p in ("low_", "high_")]
    pack = F.struct(*names)
    groups = measured.select(quoted("lang").alias("lang"), quoted("source").alias("source")).distinct()
    own = levels.filter((F.col("level") == 2) & (F.col("n") >= LEAST_DOCS)).select(
        F.col("lang").alias("lang2"), F.col("source").alias("source2"), pack.alias("own")
    )
    lang = levels.filter((F.col("level") == 1) & (F.col("n") >= LEAST_DOCS)).select(
        F.col("lang").alias("lang1"), pack.alias("by_lang")
    )
    whole = levels.filter(F.col("level") == 0).select(*names).first()  # one row, or none
    by_all = F.struct(*[F.lit(whole[c] if whole else None).cast("long").alias(c) for c in names])
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    joined = groups.join(own, same("lang", "lang2") & same("source", "source2"), "left").join(
        lang, same("lang", "lang1"), "left"
    )
    best = F.coalesce("own", "by_lang", by_all).alias("limits")
    return store(joined.select("lang", "source", best), "group-limits")


def judge(measured: DataFrame, per_group: DataFrame, kept: str, prefix: str = "") -> DataFrame:
    """``measured`` with the verdict in a column ``kept``. Limits nobody could measure reject nothing."""
    lang, source, lim = fresh(measured, "of_lang", "of_source", "of_limits")
    per = per_group.select(
        F.col("lang").alias(lang), F.col("source").alias(source), F.col("limits").alias(lim)
    )
    joined = measured.join(
        per,
        quoted("lang").eqNullSafe(quoted(lang)) & quoted("source").eqNullSafe(quoted(source)),
        "left",
    )
    fits = F.lit(True)
    for s in STATISTICS:
        inside = quoted(prefix + s).between(quoted(lim)["low_" + s], quoted(lim)["high_" + s])
        fits = fits & F.coalesce(inside, F.lit(True))
    # One expression over both sides of the join, so that no part of it is moved below the measuring.
    verdict = F.when(quoted(prefix + "base_failed"), F.lit(False)).otherwise(fits)
    return joined.withColumn(kept, verdict).drop(lang, source, lim)


def ruled(docs: DataFrame) -> DataFrame:
    """The digest of every row of ``docs(doc_id, text, lang, source)``.

    Null texts are empty and fail the base rules; a null language or source is a group of its own;
    repeated rows are judged alike; an empty table gives no rows.
    """
    narrow = measure(docs.select("doc_id", "text", "lang", "source")).drop("text")
    measured = store(narrow, "measures")  # numbers only: the texts are read once
    return judge(measured, group_limits(measured), "kept").select(
        "doc_id", *MEASURES, "base_failed", "kept"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its own columns. The texts are stored with their numbers, so
    they are measured once. Nulls, repeated rows and empty tables as in ``ruled``; very long texts are
    measured whole, and columns of any other name are kept as they are."""
    kept, prefix = fresh(docs, "rule_kept", "rule_")
    while any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        prefix += "_"
    measured = store(measure(docs, prefix), "measured-texts")
    judged = judge(measured, group_limits(measured, prefix), kept, prefix)
    return judged.filter(quoted(kept)).select(*[quoted(c) for c in docs.columns])


ORACLE = """
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cover AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n_repeat_words FROM
  (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words,
  coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN cover USING (doc_id)),
r AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM m),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  word_chars * 1000 // greatest(n_words, 1) AS word_length, n_symbols * 1000000 // greatest(n_words, 1) AS symbol_rate,
  n_dup_lines * 1000000 // greatest(len(lines), 1) AS line_rate,
  n_repeat_words * 1000000 // greatest(n_words, 1) AS repeat_rate FROM r),
e AS (UNPIVOT (SELECT doc_id, lang, source, word_length, symbol_rate, line_rate, repeat_rate FROM s WHERE NOT base_failed)
  ON word_length, symbol_rate, line_rate, repeat_rate INTO NAME statistic VALUE v),
b AS (SELECT *, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS bucket FROM e),
g AS (SELECT 2 AS level, lang, source, statistic, bucket, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, statistic, bucket, count(*) FROM b GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, statistic, bucket, count(*) FROM b GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, statistic ORDER BY bucket) AS upto,
  sum(n) OVER (PARTITION BY level, lang, source, statistic) AS every FROM g),
p(statistic, lower_q, upper_q, reach, least, two_sided) AS (VALUES ('word_length', 25, 75, 5, 0, true),
  ('symbol_rate', 50, 90, 4, 100000, false), ('line_rate', 50, 99, 1, 100000, false), ('repeat_rate', 50, 95, 6, 100000, false)),
f AS (SELECT level, lang, source, statistic, reach, least, two_sided, min(bucket) FILTER (WHERE upto * 100 >= every * lower_q) AS a,
  min(bucket) FILTER (WHERE upto * 100 >= every * upper_q) AS b FROM q JOIN p USING (statistic) GROUP BY ALL),
h AS (SELECT *, reach * greatest(b - a, b >> 7) AS spread FROM f),
z AS (SELECT level, lang, source, statistic, greatest(b + spread, least) AS hi,
  CASE WHEN two_sided THEN a - spread ELSE 0 END AS lo FROM h),
k AS (SELECT s.*, (SELECT bool_and(CASE z.statistic WHEN 'word_length' THEN word_length WHEN 'symbol_rate' THEN symbol_rate
    WHEN 'line_rate' THEN line_rate ELSE repeat_rate END BETWEEN z.lo AND z.hi) FROM z
    WHERE z.level = CASE WHEN n2 >= 200 THEN 2 WHEN n1 >= 200 THEN 1 ELSE 0 END
    AND (z.level = 0 OR z.lang IS NOT DISTINCT FROM s.lang) AND (z.level < 2 OR z.source IS NOT DISTINCT FROM s.source)) AS fits
  FROM (SELECT *, count(*) FILTER (WHERE NOT base_failed) OVER (PARTITION BY lang, source) AS n2,
    count(*) FILTER (WHERE NOT base_failed) OVER (PARTITION BY lang) AS n1 FROM s) s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(fits, true) AS kept FROM k
"""
