"""The split (hot-key) path must give what the plain window gives, for any piece size."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import joins, ordering
from millrace.operators.ordering import Asc, Desc
from millrace.operators.quantile import exact_quantile

SMALL = 40


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(1500):
        user = "hot" if i % 3 else rng.choice(["a", "b", "c", None])
        data.append(
            (i, user, rng.randrange(400), rng.choice([None, rng.randrange(50)]), rng.random())
        )
    frame = spark.createDataFrame(data, "id bigint, user string, t int, v int, x double")
    return frame.repartition(5, "id").cache()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    left = Counter(tuple(r) for r in a.select(*cols).collect())
    right = Counter(tuple(r) for r in b.select(*cols).collect())
    assert left == right


@pytest.mark.parametrize(
    "order",
    [
        [Asc("t"), Asc("id")],
        [Asc("t")],
        [Desc("v"), Asc("id")],
        [Asc("v", nulls_first=True), Desc("id")],
        [Desc("v", nulls_first=True)],
    ],
)
def test_ranks(rows, order):
    total = len(order) > 1
    args = dict(
        row_number="rn" if total else None,
        rank="r",
        dense_rank="d",
        ntile=("nt", 7) if total else None,
    )
    plain = ordering.rank_rows(rows, ["user"], order, **args)
    split = ordering.rank_rows(rows, ["user"], order, rows_per_task=SMALL, **args)
    same(plain, split)


def test_split_pieces_are_small(rows):
    pieces, hot = ordering.cut_hot(rows, ["user"], [Asc("t"), Asc("id")], SMALL)
    assert ("hot",) in hot.rows
    sizes = pieces.where("user = 'hot'").groupBy("__piece").count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 4 * SMALL


def test_rows_frame(rows):
    cols = {
        "p": lambda w: F.lag("v").over(w),
        "n": lambda w: F.lead("v", 2).over(w),
        "s": lambda w: F.sum("v").over(w.rowsBetween(-3, 0)),
    }
    order = [Asc("t"), Asc("id")]
    args = dict(before=3, after=2, first={"f": "v"})
    plain = ordering.rows_frame(rows, ["user"], order, cols, **args)
    split = ordering.rows_frame(rows, ["user"], order, cols, rows_per_task=SMALL, **args)
    same(plain, split)


def test_running_and_carry(rows):
    order = [Asc("t"), Asc("id")]
    same(
        ordering.running_sum(rows, ["user"], order, "v", "s"),
        ordering.running_sum(rows, ["user"], order, "v", "s", rows_per_task=SMALL),
    )
    sparse = rows.withColumn("v", F.when(F.col("id") % 97 == 0, F.col("v")))
    same(
        ordering.carry_last(sparse, ["user"], order, "v", "c"),
        ordering.carry_last(sparse, ["user"], order, "v", "c", rows_per_task=SMALL),
    )


def test_asof(rows):
    pdf = rows.toPandas()
    right = rows.where("id % 5 = 0").select("user", "t", "id")
    left = rows.where("id % 5 <> 0").select("id", "user", "t", "x")
    expected = {}
    marks = pdf[pdf.id % 5 == 0]
    for r in pdf[pdf.id % 5 != 0].itertuples():
        ok = marks[(marks.user == r.user) & (marks.t <= r.t)]
        best = ok.sort_values(["t", "id"]).tail(1)
        expected[r.id] = int(best.id.iloc[0]) if len(best) else None
    for size in (SMALL, 10**6):
        got = ordering.asof_join(left, right, "user", "t", "id", "hit", rows_per_task=size)
        assert {r["id"]: r["hit"] for r in got.collect()} == expected


def test_trailing_count(rows):
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("t") * 1000).cast("timestamp_ntz"))
    args = ("user", "ts", "INTERVAL 1 DAY", "n")
    same(
        ordering.trailing_count(timed, *args),
        ordering.trailing_count(timed, *args, rows_per_task=SMALL),
    )


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile(rows, p):
    pdf = rows.toPandas()
    for column in ("x", "v"):
        for accuracy in (20, 100_000):
            got = exact_quantile(rows, ["user"], column, p, "q", accuracy)
            for r in got.collect():
                mine = pdf[pdf.user.isna()] if r["user"] is None else pdf[pdf.user == r["user"]]
                values = mine[column].dropna().astype(float)
                assert r["q"] == pytest.approx(np.quantile(values, p))
            assert got.count() == pdf.user.fillna("-").nunique()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_unique(spark, rows, how):
    dim = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, w int")
    plain = rows.join(dim, rows["user"] == dim["k"], how)
    same(plain, joins.join_unique(rows, dim, {"user": "k"}, how))


@pytest.mark.parametrize("keep,how", [("facts", "left"), ("dim", "right"), ("both", "full")])
def test_foreign_key_join(spark, rows, keep, how):
    dim = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, w int")
    plain = rows.join(dim, rows["user"] == dim["k"], how)
    same(plain, joins.foreign_key_join(rows, dim, "user", "k", keep))


@pytest.mark.parametrize("size", [SMALL, 10**6])
def test_interval_count(spark, rows, size):
    bands = spark.createDataFrame(
        [(1, 0.1, 0.5), (2, 0.45, 0.9), (3, 2.0, 3.0), (4, 0.5, 0.5), (5, -1.0, 9.0), (6, 0.1, 0.5), (7, None, 0.5)],
        "band int, lo double, hi double",
    )
    xs = rows.toPandas()["x"]
    got = {r["band"]: r["n"] for r in joins.interval_count(rows, bands, "x", "lo", "hi", size).collect()}
    want = {b: int(((xs >= lo) & (xs < hi)).sum()) for b, lo, hi in
            [(1, 0.1, 0.5), (2, 0.45, 0.9), (3, 2.0, 3.0), (4, 0.5, 0.5), (5, -1.0, 9.0), (6, 0.1, 0.5)]} | {7: 0}
    assert got == want
