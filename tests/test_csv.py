import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators.export import export_csv
from millrace.sources import csv as C
from millrace.sources.lines import records, text_lines


def put(tmp_path, name, data):
    if isinstance(data, str):
        data = data.encode()
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


PARTS = "part,maker,price\n811,Ostrau,9.25\n812,Leoben,70.0\n813,Steyr,14.5\n814,Gmunden,3.0\n"
NOTED = "river gauges -- lower course\nsheet 7 of 9\ngauge,town,level\n31,Ulm,2.5\n47,Linz,8.0"


def test_typed_columns(spark, tmp_path):
    df = C.read_csv(spark, put(tmp_path, "parts.csv", PARTS))
    assert df.dtypes == [("part", "bigint"), ("maker", "string"), ("price", "double")]
    assert df.count() == 4 and [r["maker"] for r in df.where("price > 14.5").collect()] == ["Leoben"]


def test_one_odd_key_keeps_a_column_text(spark, tmp_path, sf):
    keys = [r["o_orderkey"] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()]
    body = "".join(f"{k};{k % 7}\n" for k in keys for _ in range(10))
    df = C.read_csv(spark, put(tmp_path, "keys.csv", f"order key;n\n{body}7-A/x;1\n"))
    assert df.dtypes == [("order key", "string"), ("n", "bigint")]
    assert df.count() == 10 * len(keys) + 1 and df.where("`order key` = '7-A/x'").count() == 1


def test_preamble_is_skipped(spark, tmp_path):
    path = put(tmp_path, "noted.csv", NOTED)
    prof = C.profile_csv(spark, path).first()
    assert (prof["skip_rows"], prof["n_cols"], prof["sep"]) == (2, 3, ",")
    df = C.read_csv(spark, path)
    assert [tuple(r) for r in df.orderBy("gauge").collect()] == [(31, "Ulm", 2.5), (47, "Linz", 8.0)]


def test_raw_preview(spark, tmp_path):
    path = put(tmp_path, "noted.csv", NOTED)
    rows = C.preview_csv_text(spark, path, 3).orderBy("pos").collect()
    assert [r["cells"] for r in rows] == [
        ["river gauges -- lower course"],
        ["sheet 7 of 9"],
        ["gauge", "town", "level"],
    ]
    assert all(r["truncated"] for r in rows)
    rows = C.preview_csv_text(spark, path, 5).collect()
    assert len(rows) == 5 and not rows[0]["truncated"]
    with pytest.raises(ValueError):
        C.preview_csv_text(spark, path, 101)


def test_padded_cells_and_empty_rows(spark, tmp_path):
    text = 'gauge;town;level\r\n31;Ulm;" 2.5 "\r\n;;\r\n47;Linz;"8"\r\n'
    rows = C.preview_csv_text(spark, put(tmp_path, "x.csv", text)).orderBy("pos").collect()
    assert [r["cells"] for r in rows] == [
        ["gauge", "town", "level"], ["31", "Ulm", " 2.5 "], ["", "", ""], ["47", "Linz", "8"]
    ]


def test_cp1252(spark, tmp_path):
    path = put(tmp_path, "gauges.csv", "Straße,Höhe\n„Am Fluß“,2 €\n".encode("cp1252"))
    assert C.profile_csv(spark, path).first()["encoding"] == "cp1252"
    df = C.read_csv(spark, path)
    assert df.columns == ["Straße", "Höhe"] and tuple(df.first()) == ("„Am Fluß“", "2 €")
    assert C.preview_csv_text(spark, path).first()["cells"] == ["Straße", "Höhe"]


def test_encoding_is_taken_from_the_whole_file(spark, tmp_path):
    body = "id,name\n" + "".join(f"{i},plain\n" for i in range(5000)) + "5000,João\n"
    df = C.read_csv(spark, put(tmp_path, "late.csv", body.encode("cp1252")))
    assert df.where("id = 5000").first()["name"] == "João"


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    text = "\n".join(sep.join(r) for r in [["a", "b", "c"], ["1", "x y", "2.5"], ["2", "z", "3"]])
    df = C.read_csv(spark, put(tmp_path, "d.csv", text))
    assert C.profile_csv(spark, str(tmp_path / "d.csv")).first()["sep"] == sep
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")]


def test_header_rules(spark, tmp_path):
    assert C.read_csv(spark, put(tmp_path, "a.csv", "1,2\n3,4\n")).columns == ["column0", "column1"]
    assert C.read_csv(spark, str(tmp_path / "a.csv")).count() == 2
    text = C.read_csv(spark, put(tmp_path, "b.csv", "a,b\nc,d\n"))
    assert text.columns == ["a", "b"] and text.count() == 1
    empty = C.read_csv(spark, put(tmp_path, "c.csv", "id,name\n"))
    assert empty.columns == ["id", "name"] and empty.count() == 0
    dup = C.read_csv(spark, put(tmp_path, "d.csv", "id,id,id\n1,2,x\n"))
    assert dup.columns == ["id", "id_1", "id_2"]
    blank = C.read_csv(spark, put(tmp_path, "e.csv", "a,b,\n1,2,3\n"))
    assert blank.columns == ["a", "b", "column2"]
    bom = C.read_csv(spark, put(tmp_path, "f.csv", "﻿1,2\n3,4\n"))
    assert sorted(r[0] for r in bom.collect()) == [1, 3]


def test_types(spark, tmp_path):
    text = (
        "i,code,flag,day,stamp,zoned,clock,big,x,nul\n"
        "1,007,true,2024-01-02,2024-01-02 03:04:05,2026-01-02 03:04:05+07,10:00:00,99999999999999999999,1e5,\n"
        "2,8,f,2024-02-03,2024-01-02,2026-01-02T03:04:05Z,11:30:00,3,nan,\"\"\n"
    )
    df = C.read_csv(spark, put(tmp_path, "t.csv", text))
    assert [k for _, k in df.dtypes] == [
        "bigint", "string", "boolean", "date", "timestamp_ntz", "timestamp", "time(6)",
        "decimal(38,0)", "double", "string",
    ]
    row = df.where("i = 1").first()
    assert row["code"] == "007" and row["stamp"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert row["zoned"].astimezone(dt.timezone.utc).hour == 20
    assert df.where("nul is null").count() == 2


TRICKY = (
    'id,note,n\n1,"a\nb ""q"", c",5\n2,say "hi,6\n3,"",7\n4,"x""\r\n\r\ny",8\n'
    '5,"two\nlines\nthree",9\n6,plain,10\n7,"end ""quoted""",11\n'
)


@pytest.fixture(params=["whole", "128MB", "64b"])
def blocks(spark, request, monkeypatch):
    """Small files as they are read, and the same as if they were large, in one block and in many."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if request.param != "whole":
        monkeypatch.setattr(C, "WHOLE_FILE_BYTES", 0)
        spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_breaks_in_cells_stay_as_they_are(spark, tmp_path, blocks):
    text = 'n,note\r\n1,"a\r\nb"\r\n2,"c\nd"\r\n3,"e\r\n\r\nf"\r\n4,g\r\n'
    got = C.read_csv(spark, put(tmp_path, "crlf.csv", text)).collect()
    assert {r["n"]: r["note"] for r in got} == {1: "a\r\nb", 2: "c\nd", 3: "e\r\n\r\nf", 4: "g"}


def test_quoted_line_breaks(spark, tmp_path, blocks):
    df = C.read_csv(spark, put(tmp_path, "m.csv", TRICKY))
    got = {r["id"]: r["note"] for r in df.collect()}
    assert got == {
        1: 'a\nb "q", c', 2: 'say "hi', 3: None, 4: 'x"\r\n\r\ny', 5: "two\nlines\nthree",
        6: "plain", 7: 'end "quoted"',
    }
    assert df.dtypes == [("id", "bigint"), ("note", "string"), ("n", "bigint")]


def test_blank_lines_and_inner_marks(spark, tmp_path, blocks):
    """Lines of blanks are rows and inner byte order marks are text, however large the file is."""
    text = 'word,n\n"a\nb",1\n  ,\n﻿x,2\n\ny,3\n'
    got = C.read_csv(spark, put(tmp_path, "blank.csv", text)).collect()
    assert sorted((r["word"], r["n"] or 0) for r in got) == sorted(
        [("a\nb", 1), ("  ", 0), ("﻿x", 2), ("y", 3)]
    )


def test_long_numbers_are_numbers(spark, tmp_path):
    df = C.read_csv(spark, put(tmp_path, "long.csv", "id,x\n1,1\n2,0." + "3" * 600 + "\n"))
    assert df.dtypes == [("id", "bigint"), ("x", "double")]


@pytest.mark.parametrize("block", [1, 2, 3, 5])
def test_records_across_blocks(spark, tmp_path, block):
    """Block borders anywhere, also inside quoted cells, give the same records."""
    lines = text_lines(spark, put(tmp_path, "m.csv", TRICKY * 3))
    cut = lines.withColumn("block", F.floor(F.col("pos") / block).cast("bigint"))
    marked = cut.withColumns({"sep": F.lit(","), "skip": F.lit(0)})
    got = [r["record"] for r in records(marked).orderBy("block", "pos").collect()]
    assert len(got) == 24 and sorted(set(got)) == sorted(
        ["id,note,n", '1,"a\nb ""q"", c",5', '2,say "hi,6', '3,"",7', '4,"x""\r\n\r\ny",8',
         '5,"two\nlines\nthree",9', "6,plain,10", '7,"end ""quoted""",11']
    )


def test_mixed_directory(spark, tmp_path):
    put(tmp_path, "a.csv", "id,name\n1,x\n2,é\n")
    put(tmp_path, "b.csv", "id;name\n3;y\n")
    put(tmp_path, "c.csv", "id|name\n4|Ünal\n".encode("cp1252"))
    put(tmp_path, "d.csv", 'notes\nid,name\n5,"two\nlines"\n')
    df = C.read_csv(spark, str(tmp_path))
    assert {r["id"]: r["name"] for r in df.collect()} == {
        1: "x", 2: "é", 3: "y", 4: "Ünal", 5: "two\nlines"
    }
    put(tmp_path, "e.csv", "id,other\n6,z\n")
    with pytest.raises(ValueError):
        C.read_csv(spark, str(tmp_path))


def test_wrong_width_is_an_error(spark, tmp_path):
    path = put(tmp_path, "w.csv", "a,b\n1,2\n3,4\n5,6,7\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        C.read_csv(spark, path).collect()


def test_known_dialect_and_schema(spark, tmp_path):
    path = put(tmp_path, "k.csv", PARTS)
    known = C.Dialect(sep=",", encoding="utf-8", header=True)
    df = C.read_csv(spark, path, known, "id int, name string, value decimal(9,2)")
    assert df.dtypes == [("id", "int"), ("name", "string"), ("value", "decimal(9,2)")]
    assert df.count() == 4


def test_export_text(spark, tmp_path):
    df = spark.sql(
        """SELECT 1 AS a, CAST(NULL AS STRING) AS n, '' AS e, 'q" ,x' AS q, ' pad ' AS p,
           TIMESTAMP_NTZ '2024-01-02 03:04:05.250' AS t, DATE '2024-01-02' AS d, true AS b"""
    )
    out = export_csv(df, str(tmp_path / "out"), single_file=True)
    assert out and (tmp_path / "out").read_text() == (
        "a,n,e,q,p,t,d,b\n"
        '1,,"","q"" ,x", pad ,2024-01-02 03:04:05.25,2024-01-02,true\n'
    )
    export_csv(df.where("false"), str(tmp_path / "none"))
    assert next((tmp_path / "none").glob("part-*.csv")).read_text().startswith("a,n,e")


def test_prose_with_commas_in_quoted_cells(spark, tmp_path):
    prose = "Well, it was, in short, odd.\nAnd then, nothing.\nSo, he said.\n" * 40
    rows = "".join(f'{i};"{prose}";en\n' for i in range(6))
    df = C.read_csv(spark, put(tmp_path, "prose.csv", "id;text;lang\n" + rows))
    assert df.columns == ["id", "text", "lang"] and df.count() == 6
    assert {r["text"] for r in df.collect()} == {prose}


def test_a_misread_file_follows_its_folder(spark, tmp_path):
    """The one row of the third file looks like comma-separated lines."""
    put(tmp_path, "a.csv", "id;text\n1;x\n2;y\n")
    put(tmp_path, "b.csv", "id;text\n3;z\n")
    put(tmp_path, "c.csv", 'id;text\n4;"a, b\n' + "c, d\n" * 2000 + '"\n')
    df = C.read_csv(spark, str(tmp_path))
    assert df.columns == ["id", "text"] and sorted(r["id"] for r in df.collect()) == [1, 2, 3, 4]


def test_key_value_folders(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02"):
        (tmp_path / f"day={day}").mkdir()
        put(tmp_path / f"day={day}", "x y.csv", "id,name\n1,a\n2,b\n")
    df = C.read_csv(spark, str(tmp_path))
    assert df.columns == ["id", "name"] and df.count() == 4


@pytest.mark.parametrize("notes, block", [(60, "128m"), (400, "8k"), (300, "128m")])
def test_header_at_any_depth(spark, tmp_path, notes, block):
    lines = [f"note {i}" + ", more" * (i * 5 % 4) for i in range(notes)]
    rows = [f'{i},"town ""{i % 7}"", east\nbank",{i / 4}' if i % 9 == 0 else f"{i},town {i},{i / 4}" for i in range(2000)]
    path = put(tmp_path, "deep.csv", "\n".join([*lines, "", "gauge,town,level", *rows]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        prof = C.profile_csv(spark, path).first()
        assert (prof["skip_rows"], prof["n_cols"], prof["sep"]) == (notes + 1, 3, ",")
        df = C.read_csv(spark, path)
        assert df.dtypes == [("gauge", "bigint"), ("town", "string"), ("level", "double")]
        got = {r["gauge"]: (r["town"], r["level"]) for r in df.collect()}
        assert len(got) == 2000 and got[10] == ("town 10", 2.5) and got[9] == ('town "2", east\nbank', 2.25)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("notes", [60, 400])
def test_files_of_notes_and_a_header_alone(spark, tmp_path, notes):
    """Parts without rows, more of them than parts with rows, whose notes look like rows of other widths."""
    head = "\n".join([*(f"note {i}" + ", and more" * (i * 7 % 5) for i in range(notes)), "gauge,town,level"])
    put(tmp_path, "part-0.csv", "\n".join([head, *(f"{i},town {i},{i / 4}" for i in range(900))]) + "\n")
    for part in (1, 2):
        put(tmp_path, f"part-{part}.csv", head + "\n")
    df = C.read_csv(spark, str(tmp_path))
    assert df.dtypes == [("gauge", "bigint"), ("town", "string"), ("level", "double")]
    assert {r["gauge"]: r["level"] for r in df.collect()} == {i: i / 4 for i in range(900)}


def test_runs_do_not_depend_on_the_cuts():
    from millrace.sources.even_runs import Run, joined

    text = [b"a", b'b,"x', b'y",c', b"", b"1,2,3", b'4,"5', b'5,6"",7', b'",8', b"9,10,11", b'12,"13",14']
    for cut in range(len(text) + 1):
        for second in range(cut, len(text) + 1):
            blocks = []
            for part in (text[:cut], text[cut:second], text[second:]):
                pair = [Run(False), Run(True)]
                for run in pair:
                    for line in part:
                        run.add(line, b",")
                blocks.append(pair)
            whole = joined(blocks)
            assert (whole.width, whole.n, whole.at) == (3, 5, 1)


def test_dates_by_the_whole_column(spark, tmp_path):
    text = "a,b,c,d,e\n03/04/2024,03/04/2024,1.2.2024,31-12-2023,03/04/2024\n25/12/2024,12/25/2024,2.1.2024,1-2-2024,31/31/2024\n"
    df = C.read_csv(spark, put(tmp_path, "days.csv", text))
    assert [t for _, t in df.dtypes] == ["date", "date", "date", "date", "string"]
    first = df.where("a = DATE '2024-04-03'").first()
    assert tuple(first)[:4] == (dt.date(2024, 4, 3), dt.date(2024, 3, 4), dt.date(2024, 2, 1), dt.date(2023, 12, 31))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_cut_chunk_by_chunk(spark, tmp_path, monkeypatch):
    """Lines of a file are neither shuffled nor sorted to find the records, wherever the chunks end."""
    from millrace.sources import lines as L

    rows = [f'{i},"a ""{i}"", b\r\n\r\nc",x{i}' if i % 3 else f'{i},say "hi,""' for i in range(400)]
    lines = text_lines(spark, put(tmp_path, "m.csv", "\n\nid,note,n\n" + "\r\n".join(rows) + "\r\n"))
    marked = lines.withColumns({"sep": F.lit(","), "skip": F.lit(1)})
    for size in (1, 50, 1 << 18):
        monkeypatch.setattr(L, "CHUNK_BYTES", size)
        found = records(marked, True)
        assert "value" not in plan_of(found)
        got = found.where("record != ''").orderBy("block", "pos").collect()
        assert [r["record"] for r in got] == ["id,note,n", *rows]
        assert [r["record"] for r in got if r["top"]] == ["id,note,n"]


def test_facts_of_files_need_no_sort(spark, tmp_path):
    rows = [("a", 0, 0, "﻿id,n"), ("a", 0, 1, "1,2"), ("a", 1, 2, "﻿3,4"), ("b", 0, 0, "id,n"), ("b", 0, 1, "﻿1,2")]
    facts = C._file_facts(spark.createDataFrame(rows, "path string, block bigint, pos bigint, value string"))
    assert "Sort" not in plan_of(facts)
    assert {r["path"]: (r["bom"], r["n_lines"]) for r in facts.collect()} == {"a": (True, 3), "b": (False, 2)}


def test_days_of_the_calendar(spark):
    from millrace.functions import infer

    def text(v):
        kinds = {infer.type_of(r["m"]) for r in spark.createDataFrame([(v,)], "v string").select(infer.value_class(F.col("v")).alias("m")).collect()}
        return kinds.pop()

    assert text("29/02/2024") == text("31.1.2023").replace(".", "/") == "date day first"
    assert text("2-29-2000") == text("12/31/0000") == "date month first"
    assert {text(v) for v in ("29/02/2023", "2-29-1900", "31/04/2024", "0/1/2024", "1/0/2024", "13/13/2024")} == {"string"}
