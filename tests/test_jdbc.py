"""Option building only: a read needs a database, and none may be started here."""

import pytest

from millrace.sources import jdbc as J


def test_fetch_config():
    default = {"mode": "fetchall", "arraysize": 100, "prefetchrows": 2}
    for bad in (None, "x", {}, {"mode": "?", "arraysize": 0, "prefetchrows": -1}, {"arraysize": "5"}):
        assert J.fetch_settings(bad) == default
    good = {"mode": "fetchmany", "arraysize": 5, "prefetchrows": 0}
    assert J.fetch_settings(good) == good


def test_urls():
    pg = {"host": "h", "database": "d"}
    assert J.jdbc_url("postgres", pg) == "jdbc:postgresql://h:5432/d"
    ora = {"host": "h", "port": 1522, "service_name": "s"}
    assert J.jdbc_url("oracle", ora) == "jdbc:oracle:thin:@//h:1522/s"
    with pytest.raises(ValueError):
        J.jdbc_url("other", pg)


def test_options():
    part = {"column": "id", "lower": 1, "upper": 99, "num_partitions": 8}
    got = J.read_options("u", "SELECT * FROM t;", {"arraysize": 7}, part, {"user": "x"})
    assert got == {
        "url": "u", "dbtable": "(SELECT * FROM t\n) q", "fetchsize": "7", "partitionColumn": "id",
        "lowerBound": "1", "upperBound": "99", "numPartitions": "8", "user": "x",
    }
    assert J.bounds_query("SELECT 1", "id").startswith("SELECT min(id) AS lo, max(id) AS hi FROM (")
    many = J.read_options("u", "q", {"mode": "fetchmany", "arraysize": 500})
    assert many["fetchsize"] == "500" and "partitionColumn" not in many
