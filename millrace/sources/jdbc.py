"""Database queries as tables, through Spark's JDBC source.

The whole query is sent to the database. Column names and types come from its metadata, so
an empty result keeps them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
DEFAULT_MODE = "fetchall"
DEFAULT_ARRAYSIZE = 100
DEFAULT_PREFETCHROWS = 2
POSTGRES_PORT = 5432
ORACLE_PORT = 1521

DRIVERS = {"postgres": "org.postgresql.Driver", "oracle": "oracle.jdbc.OracleDriver"}


#: Numeric fetch settings: least value, and what stands for a missing or unusable one.
FETCH_NUMBERS = {"arraysize": (1, DEFAULT_ARRAYSIZE), "prefetchrows": (0, DEFAULT_PREFETCHROWS)}


def fetch_settings(config) -> dict:
    """Mode and numbers of a fetch. Whatever is missing, of another type or too small is the default."""
    given = dict(config) if isinstance(config, Mapping) else {}
    settings = {"mode": "fetchmany" if given.get("mode") == "fetchmany" else DEFAULT_MODE}
    for name, (least, default) in FETCH_NUMBERS.items():
        value = given.get(name)
        settings[name] = value if type(value) is int and value >= least else default
    return settings


def jdbc_url(db_type: str, connection: Mapping) -> str:
    host = connection["host"]
    if db_type == "postgres":
        port = connection.get("port", POSTGRES_PORT)
        return f"jdbc:postgresql://{host}:{port}/{connection['database']}"
    if db_type == "oracle":
        port = connection.get("port", ORACLE_PORT)
        return f"jdbc:oracle:thin:@//{host}:{port}/{connection['service_name']}"
    raise ValueError(f"unknown database type {db_type!r}")


def as_subquery(query: str) -> str:
    """The query as something that can stand after FROM. No ``AS``: Oracle rejects it."""
    return f"({query.strip().rstrip(';')}\n) q"


def read_options(
    url: str,
    query: str,
    fetch_config=None,
    partition: Mapping | None = None,
    options: Mapping | None = None,
) -> dict[str, str]:
    """Options of the JDBC read.

    ``arraysize`` becomes ``fetchsize``; ``prefetchrows`` has no counterpart. With
    ``partition`` (column, lower, upper, num_partitions) the result is read in parallel
    ranges of that column; the outer ranges are open, so no row is left out.
    """
    fetch = fetch_settings(fetch_config)
    out = {"url": url, "dbtable": as_subquery(query), "fetchsize": str(fetch["arraysize"])}
    if partition:
        out |= {
            "partitionColumn": str(partition["column"]),
            "lowerBound": str(partition["lower"]),
            "upperBound": str(partition["upper"]),
            "numPartitions": str(partition["num_partitions"]),
        }
    return out | {k: str(v) for k, v in (options or {}).items()}


def bounds_query(query: str, column: str) -> str:
    return f"SELECT min({column}) AS lo, max({column}) AS hi FROM {as_subquery(query)}"


def read_query(
    spark: SparkSession,
    url: str,
    query: str,
    options: Mapping | None = None,
    fetch_config=None,
    partition: Mapping | None = None,
) -> DataFrame:
    """Result of ``query``. User, password and driver are given in ``options``.

    Rows come in portions of the fetch size, never whole. For results too large for one reader
    ``partition`` names a column and ``num_partitions``; missing bounds are asked from the database.
    """
    if partition and ("lower" not in partition or "upper" not in partition):
        lo_hi = read_options(url, bounds_query(query, partition["column"]), None, None, options)
        row = spark.read.format("jdbc").options(**lo_hi).load().first()
        if row is None or row[0] is None:
            partition = None
        else:
            partition = {**partition, "lower": row[0], "upper": row[1]}
    settings = read_options(url, query, fetch_config, partition, options)
    return spark.read.format("jdbc").options(**settings).load()


def read_db_source(
    spark: SparkSession, config: Mapping, credentials: Mapping | None = None
) -> DataFrame:
    """Table of a database source node. ``credentials`` (user, password, …) are given at
    run time and are never part of the node."""
    db_type = config.get("db_type", "postgres")
    url = config.get("url") or jdbc_url(db_type, config["connection"])
    options = {"driver": DRIVERS[db_type]} if db_type in DRIVERS else {}
    return read_query(
        spark,
        url,
        config["query"],
        {**options, **(config.get("options") or {}), **(credentials or {})},
        config.get("fetch_config"),
        config.get("partition"),
    )
