"""Ingest of files whose form is not known."""

import pytest

from millrace.streaming.ingest import ingest_files

SCHEMA = "id bigint, name string, made date"


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def rows(df):
    return sorted((r["id"], r["name"], str(r["made"])) for r in df.collect())


def test_files_of_any_form_once_each(spark, tmp_path):
    drops = tmp_path / "drops"
    put(drops, "a.csv", "id,name,made\n1,ex,2024-01-02\n2,,2024-02-03\n")
    put(drops, "b.csv", "made;id;name\n2024-03-04;3;y\n")
    run = lambda: ingest_files(spark, str(drops), str(tmp_path / "table"), str(tmp_path / "progress"), SCHEMA)
    first = [(1, "ex", "2024-01-02"), (2, None, "2024-02-03"), (3, "y", "2024-03-04")]
    assert rows(run()) == first
    put(drops, "c d.csv", "name\tmade\tid\nÜnal\t2024-05-06\t4\n".encode("cp1252"))
    put(drops, "e.csv", 'a note\nid,name,made\n5,"two\nlines",2024-07-08\n')
    put(drops, "f.csv", "")
    both = first + [(4, "Ünal", "2024-05-06"), (5, "two\nlines", "2024-07-08")]
    assert rows(run()) == both
    assert rows(run()) == both
    assert dict(run().dtypes) == {"id": "bigint", "name": "string", "made": "date"}


def test_other_columns_add_nothing(spark, tmp_path):
    drops = tmp_path / "drops"
    put(drops, "a.csv", "id,name,made\n1,ex,2024-01-02\n")
    run = lambda: ingest_files(spark, str(drops), str(tmp_path / "table"), str(tmp_path / "progress"), SCHEMA)
    assert len(rows(run())) == 1
    put(drops, "b.csv", "id,name,colour\n2,why,red\n")
    with pytest.raises(Exception, match="colour"):
        run()
    assert len(spark.read.parquet(str(tmp_path / "table")).collect()) == 1
    put(drops, "b.csv", "id,name,made\n2,why,2024-01-03\n")
    assert len(rows(run())) == 2


def test_nothing_arrived(spark, tmp_path):
    (tmp_path / "drops").mkdir()
    out = ingest_files(spark, str(tmp_path / "drops"), str(tmp_path / "table"), str(tmp_path / "progress"), SCHEMA)
    assert out.count() == 0 and out.columns == ["id", "name", "made"]
