import pytest

from millrace import tables
from millrace.plans import dag
from millrace.session import release
from millrace.sources import preprocess
from tests.test_csv import NOTED, PARTS, put


def node(id_, type_, table=None, **config):
    return {"id": id_, "type": type_, "table_name": table or id_, "config": config}


def edges(*pairs):
    return [{"source": a, "target": b} for a, b in pairs]


def spec(nodes, *pairs):
    return {"nodes": nodes, "edges": edges(*pairs)}


def by_id(frame):
    return {r["node_id"]: r for r in frame.collect()}


@pytest.fixture
def chain(tmp_path):
    src = node("src", "csv_source", file_path=put(tmp_path, "parts.csv", PARTS))
    few = node("few", "transform", "few rows", sql="SELECT * FROM src WHERE part > 811")
    top = node("top", "transform", sql="SELECT max(price) AS value, max(price) AS value FROM `few rows`")
    return spec([top, few, src], ("src", "few"), ("few", "top"))


def test_order():
    ids = lambda s: dag.run_order(s)
    plain = [node(x, "transform") for x in "abcd"]
    order = ids(spec(plain, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")))
    assert order.index("a") < min(order.index("b"), order.index("c")) and order[-1] == "d"
    assert set(ids(spec(plain))) == set("abcd")
    with pytest.raises(ValueError, match="cycle"):
        ids(spec(plain, ("a", "b"), ("b", "a")))
    with pytest.raises(ValueError, match="unknown"):
        ids(spec(plain, ("a", "z")))
    assert dag.ancestors(spec(plain, ("a", "b"), ("b", "c")), "c") == {"a", "b"}


def test_run_reuse_and_change(spark, chain, tmp_path):
    seen = []
    first = by_id(
        dag.run_dag(
            spark, chain, on_node_start=lambda n, t: seen.append(n),
            on_node_finish=lambda r: seen.append(r.status),
        )
    )
    assert seen == ["src", "success", "few", "success", "top", "success"]
    assert (first["src"]["row_count"], first["src"]["column_count"]) == (4, 3)
    assert first["few"]["row_count"] == 3 and first["top"]["columns"] == ["value", "value_1"]
    assert not any(r["reused"] for r in first.values())
    assert first["src"]["execution_time_ms"] > 0 and first["src"]["finished_at"]
    assert spark.table("top").first()[0] == 70.0

    assert all(r["reused"] for r in by_id(dag.run_dag(spark, chain)).values())
    forced = by_id(dag.run_dag(spark, chain, force=True))
    assert not any(r["reused"] for r in forced.values()) and forced["few"]["row_count"] == 3

    changed = {**chain, "nodes": [dict(n) for n in chain["nodes"]]}
    changed["nodes"][1] = {**changed["nodes"][1], "config": {"sql": "SELECT * FROM src WHERE price < 10"}}
    assert dag.drop_changed(spark, chain, changed) == ["few"]
    assert not tables.exists(spark, "few rows")
    again = by_id(dag.run_dag(spark, changed))
    assert [again[n]["reused"] for n in ("src", "few", "top")] == [True, False, False]
    assert again["few"]["row_count"] == 2 and spark.table("top").first()[0] == 9.25

    put(tmp_path, "parts.csv", PARTS + "815,Enns,11.0\n")
    grown = by_id(dag.run_dag(spark, chain))
    assert not grown["src"]["reused"] and grown["few"]["row_count"] == 4

    only = by_id(dag.run_dag(spark, chain, only="few"))
    assert set(only) == {"src", "few"} and only["src"]["reused"] and not only["few"]["reused"]


def test_faults_do_not_stop_the_run(spark, chain, tmp_path):
    path = put(tmp_path, "noted.csv", NOTED)
    on = {"enabled": True, "runtime": "bash", "script": 'tail -n +3 "$1"'}
    bad = node("bad", "transform", sql="SELECT nope FROM src")
    below = node("below", "transform", sql="SELECT 1 AS x")
    side = node("side", "csv_source", file_path=path, preprocessing=on)
    gone = node("gone", "csv_source", file_path=str(tmp_path / "none.csv"))
    odd = node("odd", "mystery")
    parts = chain["nodes"] + [bad, below, side, gone, odd]
    graph = spec(parts, ("src", "few"), ("few", "top"), ("src", "bad"), ("bad", "below"))
    got = by_id(dag.run_dag(spark, graph))
    assert {k: v["status"] for k, v in got.items()} == {
        "src": "success", "few": "success", "top": "success", "bad": "error",
        "below": "skipped", "side": "error", "gone": "error", "odd": "error",
    }
    assert "review" in got["side"]["error"] and "nope" in got["bad"]["error"]
    preprocess.prepare(spark, path, on)
    assert by_id(dag.run_node(spark, side))["side"]["row_count"] == 2


def test_views_and_export(spark, chain, tmp_path):
    out = node("out", "export", format="csv", path=str(tmp_path / "out"))
    graph = spec(chain["nodes"] + [out], ("src", "few"), ("few", "top"), ("few", "out"))
    got = by_id(dag.run_dag(spark, graph, materialize=False))
    assert got["few"]["row_count"] is None and got["few"]["columns"] == ["part", "maker", "price"]
    assert (got["out"]["status"], got["out"]["row_count"]) == ("success", 0)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3
    bad = node("x", "export", format="xml", path="y")
    failed = by_id(dag.run_dag(spark, spec(chain["nodes"] + [bad], ("src", "x"))))
    assert failed["x"]["status"] == "error"


def one(id_, sql):
    return spec([node(id_, "transform", sql=sql)])


def test_append_is_seen_by_the_next_run(spark):
    tables.materialize(spark.range(3).toDF("x"), "grown")
    count = one("grown_n", "SELECT count(*) AS n FROM grown")
    dag.run_dag(spark, count)
    assert by_id(dag.run_dag(spark, count))["grown_n"]["reused"]
    tables.append(spark.range(2).toDF("x"), "grown")
    assert not by_id(dag.run_dag(spark, count))["grown_n"]["reused"]
    assert spark.table("grown_n").first()[0] == 5


def test_databases_are_read_on_every_run(spark, monkeypatch):
    size = [3]
    monkeypatch.setattr(dag, "read_db_source", lambda s, config, given: s.range(size[0]).toDF("x"))
    plain, pinned = (spec([node(i, "db_source", query="q", **more)]) for i, more in (("db", {}), ("pin", {"version": 1})))
    for graph in (plain, pinned):
        dag.run_dag(spark, graph)
    size[0] = 9
    assert by_id(dag.run_dag(spark, plain))["db"]["row_count"] == 9
    again = by_id(dag.run_dag(spark, pinned))["pin"]
    assert again["reused"] and again["row_count"] == 3


def test_forced_rows_stay(spark, monkeypatch):
    size = [3]
    monkeypatch.setattr(dag, "read_db_source", lambda s, config, given: s.range(size[0]).toDF("x"))
    graph = spec(
        [node("f", "db_source", query="q", version=2), node("g", "transform", sql="SELECT count(*) AS n FROM f")], ("f", "g")
    )
    dag.run_dag(spark, graph)
    size[0] = 5
    dag.run_dag(spark, graph, force=True)
    release(spark)
    assert spark.table("f").count() == 5
    later = by_id(dag.run_dag(spark, graph))
    assert later["f"]["reused"] and later["g"]["reused"] and spark.table("g").first()[0] == 5


def test_appending_to_a_result_leaves_it(spark):
    graph = one("kept_m", "SELECT id AS x FROM range(4)")
    dag.run_dag(spark, graph)
    tables.append(spark.range(1).toDF("x"), "kept_m")
    assert spark.table("kept_m").count() == 5
    assert by_id(dag.run_dag(spark, graph))["kept_m"]["row_count"] == 4


def test_chance_is_not_reused(spark):
    graph = one("dice", "SELECT rand() AS r")
    dag.run_dag(spark, graph)
    assert not by_id(dag.run_dag(spark, graph))["dice"]["reused"]
