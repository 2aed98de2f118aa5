import json

import pytest
from pyspark.sql import functions as F

from millrace import tables
from millrace.functions.json_safe import as_text, json_rows, json_safe
from millrace.operators.ordering import Asc, Desc
from millrace.operators.preview import describe, page, preview
from millrace.operators.transform import sql_transform


def test_values(spark):
    df = spark.sql(
        """SELECT 'NaN'::DOUBLE AS score, 'Infinity'::DOUBLE AS high, '-Infinity'::DOUBLE AS low,
           1.5D AS x, CAST('NaN' AS FLOAT) AS f, 12.30BD AS dec, DATE '2024-01-02' AS d,
           TIMESTAMP_NTZ '2024-01-02 03:04:05' AS t0, TIMESTAMP_NTZ '2024-01-02 03:04:05.25' AS t1,
           TIMESTAMP_LTZ '2026-01-02 03:04:05+07:00' AS z, TIME '10:00:00.5' AS tm,
           INTERVAL '1 02:03:04.5' DAY TO SECOND AS iv, CAST('aé' AS BINARY) AS b, X'FF00' AS hx,
           array(1, 2) AS arr, named_struct('k', 'v') AS st, CAST(NULL AS INT) AS nothing,
           true AS flag, 'q"uote' AS s, 7L AS n"""
    )
    row = json.loads(json_rows(df).first()["row"])
    assert dict(zip(df.columns, row)) == {
        "score": "NaN", "high": "Infinity", "low": "-Infinity", "x": 1.5, "f": "NaN",
        "dec": "12.30", "d": "2024-01-02", "t0": "2024-01-02T03:04:05",
        "t1": "2024-01-02T03:04:05.250000", "z": "2026-01-01 20:04:05+00", "tm": "10:00:00.500000",
        "iv": 93784.5, "b": "aé", "hx": "ff00", "arr": "[1,2]", "st": '{"k":"v"}',
        "nothing": None, "flag": True, "s": 'q"uote', "n": 7,
    }
    safe = json_safe(df).first()
    assert safe["score"] == "NaN" and safe["iv"] == 93784.5 and safe["n"] == 7
    assert {k for _, k in as_text(df).dtypes} == {"string"}


def test_pages(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") % 7).alias("m")).repartition(5)
    order = [Desc("m"), Asc("id")]
    everything = [tuple(r) for r in df.orderBy(F.desc("m"), "id").collect()]
    for offset, limit in [(0, 10), (5, 10), (400, 25), (990, 100), (1000, 5), (5000, 5), (3, 0)]:
        want = everything[offset : offset + limit]
        for top in (100_000, 50):
            got = [tuple(r) for r in page(df, order, offset, limit, top_rows=top).collect()]
            assert got == want, (offset, limit, top)


def test_deep_pages_with_nulls_and_ties(spark):
    df = spark.range(0, 600).select(
        "id", F.when(F.col("id") % 3 != 0, F.col("id") % 2).alias("m"), F.lit("x").alias("s")
    ).repartition(4)
    for order in ([Asc("s"), Asc("m"), Desc("id")], [Desc("m", nulls_first=True), Asc("id")]):
        everything = df.orderBy(*[o.column() for o in order]).collect()
        for offset in (0, 150, 199, 390, 595):
            got = page(df, order, offset, 20, top_rows=30).collect()
            assert got == everything[offset : offset + 20], (order, offset)


def test_preview_and_schema(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, `odd name` string")
    out = preview(df, [Asc("id")], limit=1)
    assert out["rows"] == [[1, "a"]] and out["total_rows"] == 2
    assert out["columns"] == ["id", "odd name"] and out["column_types"] == ["bigint", "string"]
    assert preview(df.where("false"), [Asc("id")])["rows"] == []
    assert [(r["name"], r["type"], r["total_rows"]) for r in describe(df).orderBy("pos").collect()] == [
        ("id", "bigint", 2), ("odd name", "string", 2)
    ]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x bigint, y string")
    tables.materialize(df, "Lead Table", str(tmp_path / "t"))
    more = spark.createDataFrame([(2, "b"), (3, "c")], "p int, q string")
    assert tables.append(more, "Lead Table").count() == 3
    assert spark.table("`Lead Table`").dtypes == [("x", "bigint"), ("y", "string")]
    with pytest.raises(Exception):
        tables.append(spark.createDataFrame([("x", "b")], "p string, q string"), "Lead Table")
    grown = tables.materialize(
        spark.table("`Lead Table`").where("x > 1"), "Lead Table", str(tmp_path / "t2")
    )
    assert grown.count() == 2
    assert tables.exists(spark, "lead table")
    assert tables.drop(spark, "Lead Table") and not tables.drop(spark, "Lead Table")
    tables.register(df, "v")
    tables.register(more, "v")
    assert spark.table("v").count() == 2 and tables.drop(spark, "v")


def test_scratch_is_released(spark):
    from millrace import session

    session._made.clear()
    kept = session.store(spark.range(3), "scratch")
    assert kept.count() == 3 and session.release(spark) == 1 and session.release(spark) == 0


def test_transform_takes_queries_only(spark):
    tables.register(spark.range(5), "five")
    assert sql_transform(spark, "few", "SELECT id FROM five WHERE id > 2 -- note").count() == 2
    assert sql_transform(spark, "c", "WITH a AS (SELECT 1 AS x) SELECT * FROM a ORDER BY x").count()
    assert sql_transform(spark, "pairs", "SELECT a.id, b.id AS j FROM few a CROSS JOIN few b").count() == 4
    for bad in ("SELECT 1;", "DROP TABLE five", "SELECT nope FROM five", "SELEC 1"):
        with pytest.raises(Exception):
            sql_transform(spark, "few", bad)
    assert spark.table("few").count() == 2
