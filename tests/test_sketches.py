"""Stored sketches merged over other groupings, beside exact answers."""

from pyspark.sql import functions as F

from millrace.operators.sketches import estimates, merge, summarise


def numbers(spark):
    # Group 0 holds a third of all rows, value 5 a fifth of those.
    return spark.range(60_000).selectExpr(
        "IF(id % 3 = 0, 0, id % 50) AS g", "id % 7 AS day", "id % 9000 AS who",
        "IF(id % 5 = 0, 5D, CAST(id % 1000 AS DOUBLE)) AS v", "CAST(id % 4 AS DECIMAL(5, 1)) AS d",
    )


def test_days_merge_to_groups(spark, tmp_path):
    df = numbers(spark)
    path = str(tmp_path / "days")
    for days in ("day < 4", "day >= 4"):  # a later day is added to what is stored
        summarise(df.where(days), ["day", "g"], ["who", "d"], ["v"]).write.mode("append").parquet(path)
    kept = spark.read.parquet(path)
    ask = {"m": ("v", 0.5), "p90": ("v", 0.9)}
    for keys in (["g"], ["day"], []):
        got = estimates(merge(kept, keys), {"people": "who", "kinds": "d"}, ask)
        exact = df.groupBy(*keys).agg(
            F.count("*").alias("n"), F.countDistinct("who").alias("w"), F.countDistinct("d").alias("k")
        )
        rows = {tuple(r[k] for k in keys): r for r in got.collect()}
        for r in exact.collect():
            e = rows[tuple(r[k] for k in keys)]
            assert e["rows"] == r["n"] and e["kinds"] == r["k"]
            assert abs(e["people"] - r["w"]) <= 0.08 * r["w"]
            own = df.where(" AND ".join(f"{k} = {r[k]}" for k in keys) or "true")
            for name, share in (("m", 0.5), ("p90", 0.9)):
                if keys != ["g"] or r["g"] in (0, 1, 49):
                    below, upto = own.agg(
                        F.sum((F.col("v") < e[name]).cast("int")), F.sum((F.col("v") <= e[name]).cast("int"))
                    ).first()
                    assert below / r["n"] - 0.03 <= share <= upto / r["n"] + 0.03


def test_nulls_and_nothing(spark):
    rows = [("a", None, None), ("a", None, float("nan")), ("b", 1, 2.0), (None, 1, 3.0), (None, 2, None)]
    df = spark.createDataFrame(rows, "`a key` string, who int, v double")
    kept = summarise(df, ["a key"], ["who"], ["v"])
    got = {r["a key"]: tuple(r)[1:] for r in estimates(kept, {"w": "who"}, {"m": ("v", 0.5)}).collect()}
    assert got == {"a": (2, 0, None), "b": (1, 1, 2.0), None: (2, 2, 3.0)}
    again = {r["a key"]: tuple(r)[1:] for r in estimates(merge(kept, ["a key"]), {"w": "who"}, {"m": ("v", 0.5)}).collect()}
    assert again == got
    assert merge(kept.where("false"), ["a key"]).count() == 0


def test_approximate_count_keeps_no_sketch_per_user(spark, tmp_path):
    from millrace.plans.sql_queries import sql_queries

    rows = [("a", 1), ("a", 2), ("a", 2), (None, 3), ("b", None)]
    spark.createDataFrame(rows, "event_type string, user_id bigint").write.parquet(str(tmp_path / "events.parquet"))
    got = sql_queries()["q_approx"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "approx_count_distinct" in x and "user_id" in x.partition("functions=")[0]]
    assert {r["event_type"]: r["ok"] for r in got.collect()} == {"a": True, None: True, "b": True}
