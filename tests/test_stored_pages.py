import pytest

from millrace import storage
from millrace.operators.export import export_csv
from millrace.operators.stored_pages import positions, stored_page, stored_total


def test_pages_cover_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 7).selectExpr("id", "id % 3 AS k").write.parquet(path)
    assert stored_total(spark, path) == 1000
    pages = [[tuple(r) for r in stored_page(spark, path, at, 64).collect()] for at in range(0, 1024, 64)]
    assert sorted(r for p in pages for r in p) == [(i, i % 3) for i in range(1000)]
    assert [r[0] for p in pages for r in p] == [r["id"] for r in stored_page(spark, path, 0, 1000).collect()]
    assert pages[3] == [tuple(r) for r in stored_page(spark, path, 192, 64).collect()]
    assert stored_page(spark, path, 5000, 10).count() == 0 and stored_page(spark, path, 0, 0).count() == 0
    assert [r["at"] for r in stored_page(spark, path, 998, 10, position="at").collect()] == [998, 999]
    with pytest.raises(ValueError):
        stored_page(spark, path, -1)
    # Rows added later come last; what was there keeps its place.
    spark.range(5000, 5010).selectExpr("id", "id % 3 AS k").write.mode("append").parquet(path)
    assert stored_total(spark, path) == 1010
    assert pages[3] == [tuple(r) for r in stored_page(spark, path, 192, 64).collect()]
    assert {r["id"] for r in stored_page(spark, path, 1000, 64).collect()} == set(range(5000, 5010))
    assert spark.read.parquet(path).count() == 1010


def test_a_page_reads_its_files_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 800, 1, 8).write.parquet(path)
    assert positions(spark, path).count() == 8
    assert len(stored_page(spark, path, 150, 100).inputFiles()) == 2


def test_single_file_of_many_tasks(spark, tmp_path):
    path = str(tmp_path / "one.csv")
    df = spark.range(0, 1000, 1, 6).selectExpr("id", "concat('a,\"', id, '\"') AS t", "NULL AS n")
    export_csv(df.selectExpr("id", "t", "CAST(n AS STRING) AS n"), path, single_file=True, sep=";")
    lines = open(path).read().splitlines()
    assert lines[0] == "id;t;n" and len(lines) == 1001
    assert [int(x.split(";")[0]) for x in lines[1:]] == list(range(1000))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one.csv"]
    with pytest.raises(FileExistsError):
        export_csv(df.select("id"), path, single_file=True)
    assert len(open(path).read().splitlines()) == 1001


def test_failed_single_file_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "bad.csv")
    with pytest.raises(Exception):
        export_csv(spark.range(0, 100, 1, 4).selectExpr("CAST(raise_error('no') AS STRING) AS x"), path, single_file=True)
    assert not storage.exists(spark, path) and not list(tmp_path.iterdir())
    export_csv(spark.range(0).toDF("id"), path, single_file=True)
    assert open(path).read() == "id\n"
