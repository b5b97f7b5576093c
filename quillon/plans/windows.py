"""Queries for window functions, frames, exclusion and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as W
from ..streaming import windows as E
from .registry import query
from .tables import sql_query, table

_RANKS = "SELECT c_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, CAST(ntile(7) OVER w AS BIGINT) AS nt FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey)"
sql_query("window_ranking", _RANKS)
sql_query("window_rank_ties", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS dr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS cd FROM {part}")
sql_query("window_values", "SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER w AS l, nth_value(o_totalprice, 3) OVER w AS n3 FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
sql_query("window_lead_lag", "SELECT o_orderkey, lead(o_totalprice) OVER w AS a, lead(o_totalprice, 2) OVER w AS b, lag(o_totalprice, 1, -1.0) OVER w AS c, lag(o_orderstatus) OVER w AS d FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
sql_query("window_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS run, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM {orders}")
sql_query("window_default_frame_peers", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS s FROM {part}")
sql_query("window_rows_frame", "SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS s, max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM {lineitem}")
sql_query("window_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS n FROM {part}")
sql_query("window_no_order", "SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS n, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey) AS BIGINT) AS t FROM {nation}")
sql_query("window_named", "SELECT s_suppkey, round(avg(s_acctbal) OVER w, 6) AS a, min(s_acctbal) OVER w AS lo, max(s_acctbal) OVER w AS hi FROM {supplier} WINDOW w AS (PARTITION BY s_nationkey)")
sql_query("window_over_aggregate", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total FROM {orders} GROUP BY o_orderstatus, o_orderpriority")
sql_query("window_top_n_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) t WHERE r <= 2")


@query("window_chained", "SELECT o_orderkey, round(sum(o_totalprice) OVER (w ORDER BY o_orderkey), 2) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def window_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window that extends another: the base's partitioning with an order added."""
    whole = W.base(["o_custkey"], [])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(whole.orderBy("o_orderkey")), 2).alias("s"))


@query("window_groups_frame", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM part")
def window_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, w = W.groups_frame(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_size")], -1, 1)
    _, back = W.groups_frame(df, ["p_brand"], [F.col("p_size")], -2, 0)
    return df.select("p_partkey", F.sum("p_size").over(w).alias("s"), F.count(F.lit(1)).over(back).alias("n"))


def _excluded(what: str, rows: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = table(spark, sf_dir, "part")
        e = W.exclude(F.col("p_size"), ["p_brand"], [F.col("p_size")], W.FIRST, W.LAST if rows else W.HERE, what, rows)
        return part.select("p_partkey", e["sum"].cast("bigint").alias("s"), e["count"].alias("n"), F.round(e["avg"], 6).alias("a"))

    return run


for _name, _what, _rows in (("group", "group", True), ("ties", "ties", True), ("group_range", "group", False), ("ties_range", "ties", False), ("current_row", "current row", True)):
    _frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING" if _rows else "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    _over = f"OVER (PARTITION BY p_brand ORDER BY p_size {_frame} EXCLUDE {_what.upper()})"
    query(f"window_exclude_{_name}", f"SELECT p_partkey, CAST(sum(p_size) {_over} AS BIGINT) AS s, count(p_size) {_over} AS n, round(avg(p_size) {_over}, 6) AS a FROM part")(_excluded(_what, _rows))


@query("window_exclude_extreme", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS hi FROM orders")
def window_exclude_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    hi = W.extreme_without_current(F.col("o_totalprice"), ["o_custkey"], [F.col("o_orderkey")], -2, 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", hi.alias("hi"))


@query("window_filter", "SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders")
def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = W.filtered(F.count, F.lit(1), F.col("o_totalprice") > 100000, W.base(["o_custkey"], [F.col("o_orderkey")]))
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"))


@query("event_windows", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.tumbling(table(spark, sf_dir, "events"), "1 hour")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("event_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def _anywhere(what: str, kind: str, start: int, end: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = W.exclude_anywhere(table(spark, sf_dir, "part").select("p_brand", "p_size"), "p_size", ["p_brand"], ["p_size"], start, end, what, kind)
        return found.select("p_brand", "p_size", F.col("sum").cast("bigint").alias("s"), F.col("count").cast("bigint").alias("n"), F.round("avg", 6).alias("a"))

    return run


for _kind in ("rows", "groups"):
    for _what in ("current row", "group", "ties"):
        for _place, _start, _end, _words in (("around", -3, 2, "3 PRECEDING AND 2 FOLLOWING"), ("ahead", 1, 3, "1 FOLLOWING AND 3 FOLLOWING")):
            _over = f"OVER (PARTITION BY p_brand ORDER BY p_size {_kind.upper()} BETWEEN {_words} EXCLUDE {_what.upper()})"
            query(f"window_exclude_{_what.replace(' ', '_')}_{_kind}_{_place}", f"SELECT p_brand, p_size, CAST(sum(p_size) {_over} AS BIGINT) AS s, count(p_size) {_over} AS n, round(avg(p_size) {_over}, 6) AS a FROM part")(_anywhere(_what, _kind, _start, _end))
