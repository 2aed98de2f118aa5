"""One checked query per family of the SQL surface a transform can use.

``TEXT`` holds plain Spark SQL, run through the SQL transform. ``FRAMES`` holds the
families whose plain form sends a whole key to one task (outer joins on a foreign key,
windows, as-of, quantile, range counts): they use the operators that split hot keys.
``ORACLE`` holds the same results in DuckDB's dialect; where the text is equal it is
taken from ``TEXT``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import joins, ordering, sets
from millrace.operators.bands import band_join
from millrace.operators.ordering import Asc, Desc
from millrace.operators.quantile import exact_quantiles
from millrace.operators.transform import query
from millrace.plans.sources import register_named, table
from millrace.session import tune

TEXT: dict[str, str] = {}
ORACLE: dict[str, str] = {}
FRAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def both(name: str, sql: str) -> None:
    TEXT[name] = sql
    ORACLE[name] = sql


def pair(name: str, spark_sql: str, duck_sql: str) -> None:
    TEXT[name] = spark_sql
    ORACLE[name] = duck_sql


def frame(name: str, duck_sql: str):
    def add(fn):
        FRAMES[name] = fn
        ORACLE[name] = duck_sql
        return fn

    return add


# --- projection, filters -------------------------------------------------------------

both("q_project", "SELECT o_orderkey AS id, o_totalprice * 2 AS doubled, o_orderstatus FROM orders")
both("q_filter", "SELECT * FROM orders WHERE o_totalprice > 1000 AND o_orderstatus IN ('F','O')")
both(
    "q_in_between_like",
    """SELECT p_partkey FROM part
       WHERE p_size BETWEEN 5 AND 20 AND p_name LIKE '%a%' AND p_brand IS NOT NULL
         AND NOT (p_size = 7 OR p_type IS NULL)""",
)

# --- joins ---------------------------------------------------------------------------

# Orders are counted per customer before the join: a customer with very many orders
# reaches the join as one row.
pair(
    "q_join_group",
    """SELECT c.c_name AS name, sum(o.n) AS order_count
       FROM customer c
       JOIN (SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey) o
         ON o.o_custkey = c.c_custkey
       GROUP BY c.c_name""",
    """SELECT c.c_name AS name, count(o.o_orderkey) AS order_count
       FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_name""",
)


@frame(
    "q_inner",
    """SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey
       WHERE c_acctbal > 0""",
)
def q_inner(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    joined = joins.join_unique(orders, customer, {"o_custkey": "c_custkey"})
    return joined.select("o_orderkey", "c_name", "o_totalprice")


@frame(
    "q_left",
    """SELECT c_custkey, o_orderkey FROM customer
       LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000""",
)
def q_left(spark, sf):
    return _orders_of_customers(spark, sf, 250000, "dim")


@frame(
    "q_right",
    """SELECT c_custkey, o_orderkey FROM
       (SELECT * FROM customer WHERE c_acctbal > 0) c
       RIGHT JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) o ON o_custkey = c_custkey""",
)
def q_right(spark, sf):
    return _orders_of_customers(spark, sf, 100000, "facts", "c_acctbal > 0")


@frame(
    "q_full",
    """SELECT c_custkey, o_orderkey FROM
       (SELECT * FROM customer WHERE c_acctbal > 0) c
       FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON o_custkey = c_custkey""",
)
def q_full(spark, sf):
    return _orders_of_customers(spark, sf, 300000, "both", "c_acctbal > 0")


def _orders_of_customers(spark, sf, price, keep, customers="true"):
    orders = table(spark, sf, "orders").where(F.col("o_totalprice") > price)
    orders = orders.select("o_orderkey", "o_custkey")
    customer = table(spark, sf, "customer").where(customers).select("c_custkey")
    joined = joins.foreign_key_join(orders, customer, "o_custkey", "c_custkey", keep)
    return joined.select("c_custkey", "o_orderkey")


# Keys on the searched side are made distinct first, which map tasks do before shuffling.
pair(
    "q_semi",
    """SELECT c_custkey FROM customer LEFT SEMI JOIN
       (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) o
       ON o_custkey = c_custkey""",
    """SELECT c_custkey FROM customer SEMI JOIN
       (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) o ON o_custkey = c_custkey""",
)
pair(
    "q_anti",
    """SELECT c_custkey FROM customer LEFT ANTI JOIN
       (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 250000) o
       ON o_custkey = c_custkey""",
    """SELECT c_custkey FROM customer ANTI JOIN
       (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) o ON o_custkey = c_custkey""",
)
pair(
    "q_notexists",
    """SELECT c_custkey FROM customer WHERE NOT EXISTS
         (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 250000) o
          WHERE o.o_custkey = c_custkey)
       AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)""",
    """SELECT c_custkey FROM customer WHERE NOT EXISTS
         (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)
       AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)""",
)
pair(
    "q_exists",
    """SELECT s_suppkey FROM supplier WHERE EXISTS
         (SELECT 1 FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity >= 50) l
          WHERE l.l_suppkey = s_suppkey)""",
    """SELECT s_suppkey FROM supplier WHERE EXISTS
         (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)""",
)


@frame(
    "q_band",
    """SELECT c_custkey, c_acctbal, min(s_suppkey) AS s_suppkey, arg_min(s_acctbal, s_suppkey) AS low,
              arg_min(s_acctbal + 25, s_suppkey) AS high
       FROM customer LEFT JOIN supplier ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 25
       GROUP BY c_custkey, c_acctbal""",
)
def q_band(spark, sf):
    """Customers with the first supplier, by key, whose band holds their balance."""
    low = F.col("s_acctbal")
    bands = table(spark, sf, "supplier").select("s_suppkey", low.alias("low"), (low + 25).alias("high"))
    points = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return band_join(points, bands, "c_acctbal", "low", "high", ["s_suppkey"])


@frame(
    "q_theta",
    """SELECT b.s_nationkey, b.lo, b.hi, count(c_custkey) AS n
       FROM (SELECT s_nationkey, min(s_acctbal) AS lo, max(s_acctbal) AS hi
             FROM supplier GROUP BY s_nationkey) b
       LEFT JOIN customer c ON c.c_acctbal >= b.lo AND c.c_acctbal < b.hi
       GROUP BY b.s_nationkey, b.lo, b.hi""",
)
def q_theta(spark, sf):
    bands = (
        table(spark, sf, "supplier")
        .groupBy("s_nationkey")
        .agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    )
    points = table(spark, sf, "customer").select("c_acctbal")
    return joins.interval_count(points, bands, "c_acctbal", "lo", "hi")


@frame(
    "q_asof",
    """SELECT p.event_id, arg_max(v.event_id, {'a': v.ts, 'b': v.event_id}) AS last_view
       FROM events p LEFT JOIN events v
         ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts
       WHERE p.event_type = 'purchase' GROUP BY p.event_id""",
)
def q_asof(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    bought = events.where("event_type = 'purchase'")
    viewed = events.where("event_type = 'view'")
    found = ordering.asof_join(bought, viewed, "user_id", "ts", "event_id", "last_view")
    return found.select("event_id", "last_view")


# The best order per customer as an aggregate: combined on the map side, never sorted.
pair(
    "q_lateral",
    """SELECT c_custkey, t.o_orderkey FROM customer, LATERAL
         (SELECT max_by(o_orderkey, struct(o_totalprice, -o_orderkey)) AS o_orderkey
          FROM orders WHERE o_custkey = c_custkey) t
       WHERE t.o_orderkey IS NOT NULL""",
    """SELECT c_custkey, t.o_orderkey FROM customer, LATERAL
         (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey
          ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t""",
)

# --- aggregation ---------------------------------------------------------------------

pair(
    "q_agg_int",
    """SELECT l_returnflag, count(*) AS n, sum(l_linenumber) AS s, min(l_shipdate) AS a,
              max(l_shipdate) AS b, round(avg(l_discount), 6) AS d
       FROM lineitem GROUP BY l_returnflag""",
    """SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s,
              min(l_shipdate) AS a, max(l_shipdate) AS b, round(avg(l_discount), 6) AS d
       FROM lineitem GROUP BY l_returnflag""",
)
both(
    "q_group_all",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top
       FROM orders GROUP BY ALL""",
)
both(
    "q_distinct_agg",
    "SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY event_type",
)
both(
    "q_agg_filter",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f
       FROM orders GROUP BY o_orderpriority""",
)
both(
    "q_having",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10",
)
both(
    "q_gsets",
    """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
       GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""",
)
pair(
    "q_cube",
    # Counted to the finest groups first: the cube then repeats groups, not rows.
    """SELECT l_returnflag, l_linestatus, sum(n) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g
       FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
       GROUP BY CUBE (l_returnflag, l_linestatus)""",
    """SELECT l_returnflag, l_linestatus, count(*) AS n,
              CAST(grouping(l_returnflag) AS BIGINT) AS g
       FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
both(
    "q_rollup",
    """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
       GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)


@frame("q_approx", "SELECT event_type, TRUE AS ok FROM events GROUP BY event_type")
def q_approx(spark, sf):
    """Two aggregates: in one, Spark keeps a sketch for every distinct user to reach the exact count."""
    events = table(spark, sf, "events").select("event_type", "user_id")
    rough = events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("rough"))
    exact = events.groupBy(F.col("event_type").alias("same_type")).agg(F.count_distinct("user_id").alias("n"))
    both = rough.join(exact, F.col("event_type").eqNullSafe(F.col("same_type")))
    return both.select("event_type", (10 * F.abs(F.col("rough") - F.col("n")) <= F.col("n")).alias("ok"))


@frame(
    "q_quant",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS m,
              round(quantile_cont(value, 0.9), 6) AS p90,
              round(stddev_samp(value), 6) AS sd,
              arg_max(event_id, {'a': value, 'b': event_id}) AS mb
       FROM events GROUP BY event_type""",
)
def q_quant(spark, sf):
    events = table(spark, sf, "events").select("event_type", "event_id", "value")
    plain = events.groupBy("event_type").agg(
        F.round(F.stddev_samp("value"), 6).alias("sd"),
        F.max_by("event_id", F.struct("value", "event_id")).alias("mb"),
    )
    exact = exact_quantiles(events, ["event_type"], "value", {"m": 0.5, "p90": 0.9})
    out = plain.join(exact, "event_type", "left")
    return out.withColumns({"m": F.round("m", 6), "p90": F.round("p90", 6)})


# Only distinct values are gathered, so an array is as long as the column has values
# (event types, priorities), however many rows a key has.
pair(
    "q_listagg",
    """SELECT user_id, listagg(event_type, ',') WITHIN GROUP (ORDER BY event_type) AS s
       FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""",
    """SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS s
       FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""",
)
pair(
    "q_collect",
    """SELECT o_custkey, array_sort(collect_set(o_orderpriority)) AS a
       FROM orders GROUP BY o_custkey""",
    """SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS a
       FROM orders GROUP BY o_custkey""",
)

# --- windows -------------------------------------------------------------------------


@frame(
    "q_rank",
    """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS r,
              dense_rank() OVER w AS dr, ntile(4) OVER w AS nt
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""",
)
def q_rank(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderkey")
    ranked = ordering.rank_rows(
        orders,
        ["o_custkey"],
        [Asc("o_totalprice"), Asc("o_orderkey")],
        row_number="rn",
        rank="r",
        dense_rank="dr",
        ntile=("nt", 4),
    )
    return ranked.select("o_orderkey", "rn", "r", "dr", "nt")


@frame(
    "q_lag",
    """SELECT event_id, lag(value) OVER w AS p, lead(value) OVER w AS n,
              first_value(value) OVER w AS f
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def q_lag(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    columns = {"p": lambda w: F.lag("value").over(w), "n": lambda w: F.lead("value").over(w)}
    out = ordering.rows_frame(
        events,
        ["user_id"],
        [Asc("ts"), Asc("event_id")],
        columns,
        before=1,
        after=1,
        first={"f": "value"},
    )
    return out.select("event_id", "p", "n", "f")


@frame(
    "q_rows",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s FROM events""",
)
def q_rows(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = ordering.rows_frame(
        events,
        ["user_id"],
        [Asc("ts"), Asc("event_id")],
        {"s": lambda w: F.sum("value").over(w.rowsBetween(-2, 0))},
        before=2,
    )
    return out.select("event_id", F.round("s", 4).alias("s"))


@frame(
    "q_range",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
                RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS s FROM events""",
)
def q_range(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    out = ordering.trailing_count(events, "user_id", "ts", "INTERVAL 1 DAY", "s")
    return out.select("event_id", "s")


# The same operators where a few keys hold all rows, cut into pieces of a sixteenth of the table.
SHARES = 16


def _piece_rows(df: DataFrame) -> int:
    return max(1, df.count() // SHARES)


@frame(
    "q_rank_hot",
    """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS r,
              dense_rank() OVER w AS dr, ntile(7) OVER w AS nt
       FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)""",
)
def q_rank_hot(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice", "o_orderkey")
    ranked = ordering.rank_rows(
        orders,
        ["o_orderstatus"],
        [Asc("o_totalprice"), Asc("o_orderkey")],
        row_number="rn",
        rank="r",
        dense_rank="dr",
        ntile=("nt", 7),
        rows_per_task=_piece_rows(orders),
    )
    return ranked.drop("o_orderstatus", "o_totalprice")


@frame(
    "q_lag_hot",
    """SELECT event_id, lag(value) OVER w AS p, lead(value) OVER w AS n,
              first_value(value) OVER w AS f
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def q_lag_hot(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    columns = {"p": lambda w: F.lag("value").over(w), "n": lambda w: F.lead("value").over(w)}
    order, rows = [Asc("ts"), Asc("event_id")], _piece_rows(events)
    out = ordering.rows_frame(
        events, ["event_type"], order, columns, 1, 1, {"f": "value"}, rows_per_task=rows
    )
    return out.select("event_id", "p", "n", "f")


@frame(
    "q_range_hot",
    """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts
                RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS s FROM events""",
)
def q_range_hot(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    rows = _piece_rows(events)
    out = ordering.trailing_count(events, "event_type", "ts", "INTERVAL 1 DAY", "s", rows)
    return out.select("event_id", "s")


@frame(
    "q_asof_hot",
    """SELECT p.event_id, v.last_view
       FROM (SELECT event_id, user_id % 2 AS k, ts FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN
            (SELECT user_id % 2 AS k, ts, max(event_id) AS last_view FROM events
             WHERE event_type = 'view' GROUP BY 1, 2) v
         ON p.k = v.k AND p.ts >= v.ts""",
)
def q_asof_hot(spark, sf):
    events = table(spark, sf, "events").selectExpr("event_id", "user_id % 2 AS k", "event_type", "ts")
    bought = events.where("event_type = 'purchase'").drop("event_type")
    viewed = events.where("event_type = 'view'").drop("event_type")
    rows = _piece_rows(events)
    found = ordering.asof_join(
        bought, viewed, "k", "ts", "event_id", "last_view", rows_per_task=rows
    )
    return found.select("event_id", "last_view")


# A rank limit is pushed below the shuffle: map tasks keep two rows per customer.
pair(
    "q_qualify",
    """SELECT o_orderkey, CAST(rn AS BIGINT) AS rn FROM
         (SELECT o_orderkey, row_number() OVER
            (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
       WHERE rn <= 2""",
    """SELECT o_orderkey, row_number() OVER
         (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
       FROM orders QUALIFY rn <= 2""",
)


@frame(
    "q_nullsorder",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey
                ORDER BY k ASC NULLS LAST, o_orderkey DESC) AS rn
       FROM (SELECT o_custkey, o_orderkey, nullif(o_orderstatus, 'F') AS k FROM orders)""",
)
def q_nullsorder(spark, sf):
    orders = table(spark, sf, "orders").selectExpr(
        "o_custkey", "o_orderkey", "nullif(o_orderstatus, 'F') AS k"
    )
    out = ordering.rank_rows(
        orders, ["o_custkey"], [Asc("k"), Desc("o_orderkey")], row_number="rn"
    )
    return out.select("o_orderkey", "rn")


both(
    "q_topk",
    """SELECT o_orderkey, o_totalprice FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5""",
)

# --- set operations ------------------------------------------------------------------

both("q_distinct", "SELECT DISTINCT c_mktsegment FROM customer")
both("q_union", "SELECT c_nationkey AS x FROM customer UNION SELECT s_nationkey FROM supplier")
both(
    "q_unionall",
    "SELECT o_orderkey AS x, 'o' AS src FROM orders UNION ALL SELECT l_orderkey, 'l' FROM lineitem",
)
pair(
    "q_intersect",
    """SELECT DISTINCT c_nationkey AS k FROM customer
       INTERSECT SELECT DISTINCT s_nationkey FROM supplier""",
    "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
)
pair(
    "q_except",
    """SELECT DISTINCT c_nationkey AS k FROM customer
       EXCEPT SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 9000""",
    """SELECT c_nationkey AS k FROM customer
       EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000""",
)


@frame(
    "q_exceptall",
    "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
)
def q_exceptall(spark, sf):
    return sets.except_all(*_nation_keys(spark, sf))


@frame(
    "q_intersectall",
    "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
)
def q_intersectall(spark, sf):
    return sets.intersect_all(*_nation_keys(spark, sf))


def _nation_keys(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    return customers, table(spark, sf, "supplier").select("s_nationkey")


# --- subqueries, CTEs, reshaping -----------------------------------------------------


@frame(
    "q_scalar_sub",
    """SELECT o_orderkey FROM orders o WHERE o_totalprice >
         (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""",
)
def q_scalar_sub(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    means = orders.groupBy(F.col("o_custkey").alias("__k")).agg(
        F.avg("o_totalprice").alias("__mean")
    )
    joined = joins.join_unique(orders, means, {"o_custkey": "__k"})
    return joined.where("o_totalprice > __mean").select("o_orderkey")


both(
    "q_scalar_total",
    """SELECT o_orderkey FROM orders
       WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)""",
)
both(
    "q_cte",
    """WITH spend AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1),
            big AS (SELECT * FROM spend WHERE n >= 5)
       SELECT c_mktsegment, count(*) AS customers, max(top) AS top
       FROM big JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""",
)
# The recursion builds the calendar of quarters the orders span; it reads them once for
# its bounds and once for the counts.
pair(
    "q_cte_rec",
    """WITH RECURSIVE bounds AS
         (SELECT date_trunc('quarter', min(o_orderdate)) AS lo, max(o_orderdate) AS hi FROM orders),
       spine(quarter, hi) AS
         (SELECT lo, CAST(hi AS TIMESTAMP) FROM bounds
          UNION ALL
          SELECT quarter + INTERVAL 3 MONTH, hi FROM spine WHERE quarter + INTERVAL 3 MONTH <= hi),
       counts AS
         (SELECT date_trunc('quarter', o_orderdate) AS q, count(*) AS n FROM orders GROUP BY 1)
       SELECT CAST(quarter AS TIMESTAMP_NTZ) AS quarter, coalesce(n, 0) AS n
       FROM spine LEFT JOIN counts ON q = quarter""",
    """WITH RECURSIVE bounds AS
         (SELECT date_trunc('quarter', min(o_orderdate)) AS lo, max(o_orderdate) AS hi FROM orders),
       spine(quarter, hi) AS
         (SELECT CAST(lo AS TIMESTAMP), hi FROM bounds
          UNION ALL
          SELECT quarter + INTERVAL 3 MONTH, hi FROM spine WHERE quarter + INTERVAL 3 MONTH <= hi),
       counts AS
         (SELECT CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q, count(*) AS n
          FROM orders GROUP BY 1)
       SELECT quarter, coalesce(n, 0) AS n FROM spine LEFT JOIN counts ON q = quarter""",
)
pair(
    "q_pivot",
    """SELECT * FROM (SELECT o_orderpriority AS p, o_orderstatus AS s, 1L AS n FROM orders)
       PIVOT (sum(n) FOR s IN ('F' AS f, 'O' AS o))""",
    """SELECT o_orderpriority AS p,
              CAST(sum(1) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS f,
              CAST(sum(1) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS o
       FROM orders GROUP BY 1""",
)
both(
    "q_unpivot",
    """SELECT o_orderkey, k, v FROM
         (SELECT o_orderkey, o_totalprice AS price, o_totalprice * 2 AS doubled FROM orders)
       UNPIVOT (v FOR k IN (price, doubled))""",
)

# --- scalar functions ----------------------------------------------------------------

pair(
    "q_cond",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'neg' ELSE 'pos' END AS k,
              coalesce(nullif(c_name, ''), '?') AS n, CAST(c_acctbal AS STRING) AS s,
              try_cast(c_name AS INT) AS i, c_custkey::STRING AS t,
              try_cast(split_part(c_name, '#', 2) AS BIGINT) AS num
       FROM customer""",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'neg' ELSE 'pos' END AS k,
              coalesce(nullif(c_name, ''), '?') AS n, CAST(c_acctbal AS VARCHAR) AS s,
              try_cast(c_name AS INT) AS i, c_custkey::VARCHAR AS t,
              try_cast(split_part(c_name, '#', 2) AS BIGINT) AS num
       FROM customer""",
)
pair(
    "q_divzero",
    "SELECT event_id, value / nullif(event_id % 2, 0) AS q FROM events",
    "SELECT event_id, value / nullif(event_id % 2, 0) AS q FROM events",
)
pair(
    "q_nonfinite",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE
                WHEN 2 THEN '-Infinity'::DOUBLE ELSE value END AS x,
              isnan(CASE event_id % 4 WHEN 0 THEN 'NaN'::DOUBLE ELSE value END) AS is_nan
       FROM events""",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE
                WHEN 2 THEN '-Infinity'::DOUBLE ELSE value END AS x,
              isnan(CASE event_id % 4 WHEN 0 THEN 'NaN'::DOUBLE ELSE value END) AS is_nan
       FROM events""",
)
pair(
    "q_str",
    """SELECT upper(c_name) AS u, lower(c_name) AS l, CAST(length(c_name) AS BIGINT) AS n,
              substr(c_name, 1, 4) AS s, trim(c_name) AS t, replace(c_name, '#', '-') AS r,
              concat(c_name, '!') AS c, lpad(c_mktsegment, 12, '*') AS lp,
              split_part(c_name, '#', 2) AS sp, reverse(c_name) AS rv,
              regexp_replace(c_name, '[0-9]+', 'N') AS rr
       FROM customer""",
    """SELECT upper(c_name) AS u, lower(c_name) AS l, length(c_name) AS n,
              substr(c_name, 1, 4) AS s, trim(c_name) AS t, replace(c_name, '#', '-') AS r,
              concat(c_name, '!') AS c, lpad(c_mktsegment, 12, '*') AS lp,
              split_part(c_name, '#', 2) AS sp, reverse(c_name) AS rv,
              regexp_replace(c_name, '[0-9]+', 'N') AS rr
       FROM customer""",
)
pair(
    "q_date",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y,
              CAST(month(o_orderdate) AS BIGINT) AS m,
              CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS t,
              CAST(extract(dow FROM o_orderdate) AS BIGINT) AS d,
              date_diff(DAY, TIMESTAMP_NTZ '1992-01-01 00:00:00', o_orderdate) AS dd,
              o_orderdate + INTERVAL 1 MONTH AS nm
       FROM orders""",
    """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m,
              CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t,
              extract(dow FROM o_orderdate) + 1 AS d,
              date_diff('day', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS dd,
              o_orderdate + INTERVAL 1 MONTH AS nm
       FROM orders""",
)
pair(
    "q_math",
    """SELECT o_orderkey, abs(o_totalprice) AS a, ceil(o_totalprice) AS c,
              floor(o_totalprice) AS f, round(o_totalprice, 1) AS r,
              round(sqrt(abs(o_totalprice)), 6) AS q,
              CAST(sign(o_totalprice - 100000) AS BIGINT) AS g, o_orderkey % 3 AS m,
              power(CAST(o_orderkey % 10 AS DOUBLE), 3) AS p,
              greatest(o_totalprice, 150000D) AS gr
       FROM orders""",
    """SELECT o_orderkey, abs(o_totalprice) AS a, CAST(ceil(o_totalprice) AS BIGINT) AS c,
              CAST(floor(o_totalprice) AS BIGINT) AS f, round(o_totalprice, 1) AS r,
              round(sqrt(abs(o_totalprice)), 6) AS q,
              CAST(sign(o_totalprice - 100000) AS BIGINT) AS g, o_orderkey % 3 AS m,
              pow(CAST(o_orderkey % 10 AS DOUBLE), 3) AS p,
              greatest(o_totalprice, 150000) AS gr
       FROM orders""",
)
pair(
    "q_json",
    "SELECT event_id, get_json_object(props, '$.k') AS k FROM events",
    "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
)
pair(
    "q_array",
    """SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, embedding[0] AS f,
              element_at(embedding, -1) AS z, slice(embedding, 2, 3) AS part
       FROM embeddings""",
    """SELECT vec_id, len(embedding) AS n, embedding[1] AS f, embedding[-1] AS z,
              embedding[2:4] AS part
       FROM embeddings""",
)
pair(
    "q_explode",
    """SELECT vec_id, CAST(pos AS BIGINT) AS i, v
       FROM embeddings LATERAL VIEW posexplode(embedding) AS pos, v""",
    """SELECT vec_id, i - 1 AS i, v FROM
         (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v
          FROM embeddings)""",
)
pair(
    "q_hof",
    """SELECT vec_id,
              round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE)),
                    0D, (a, x) -> a + x), 4) AS s,
              exists(embedding, x -> x > 0) AS e,
              CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS n
       FROM embeddings""",
    """SELECT vec_id,
              round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS s,
              len(list_filter(embedding, lambda x: x > 0)) > 0 AS e,
              len(list_filter(embedding, lambda x: x > 0)) AS n
       FROM embeddings""",
)
pair(
    "q_mapfn",
    """SELECT event_id, map('t', event_type)['t'] AS t, named_struct('u', user_id).u AS u
       FROM events""",
    """SELECT event_id, map {'t': event_type}['t'] AS t, struct_extract({'u': user_id}, 'u') AS u
       FROM events""",
)
pair(
    "q_tumble",
    """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS w, event_type, count(*) AS n
       FROM events GROUP BY 1, 2""",
    """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS w, event_type, count(*) AS n
       FROM events GROUP BY 1, 2""",
)


def _run(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_named(spark, sf_dir, sql)
        return query(spark, sql)

    return call


def _framed(fn) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    return call


def sql_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _run(sql) for name, sql in TEXT.items()}
    out |= {name: _framed(fn) for name, fn in FRAMES.items()}
    return out
