"""Queries for scans, predicates, joins, aggregation, set operations, subqueries and CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import bands as B
from ..operators import changes as C
from ..operators import percentiles as P
from ..operators import recursion as R
from ..sources import tables as X
from .registry import query
from .tables import sql_query, table

# --- star-schema queries --------------------------------------------------------------------------------

sql_query("tpch_q1_pricing_summary", """
SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
 round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM {lineitem} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
sql_query("tpch_q3_top_unshipped", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, substr(CAST(o_orderdate AS STRING), 1, 10) AS orderdate
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
sql_query("tpch_q4_priority", """
SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01'
 AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""")
sql_query("tpch_q5_local_supplier", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
 JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name""")
sql_query("tpch_q6_forecast", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem}
WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
sql_query("tpch_q8_market_share", """
SELECT o_year, round(sum(CASE WHEN nation = 'FRANCE' THEN volume ELSE 0 END) / sum(volume), 8) AS share FROM (
 SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
 FROM {part} JOIN {lineitem} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {orders} ON l_orderkey = o_orderkey
  JOIN {customer} ON o_custkey = c_custkey JOIN {nation} n1 ON c_nationkey = n1.n_nationkey JOIN {region} ON n1.n_regionkey = r_regionkey JOIN {nation} n2 ON s_nationkey = n2.n_nationkey
 WHERE r_name = 'EUROPE') AS all_nations GROUP BY o_year""")
sql_query("tpch_q10_returns", """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {nation} ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
sql_query("tpch_q12_modes", """
SELECT l_linestatus, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY l_linestatus""")
sql_query("tpch_q13_distribution", """
SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus <> 'F' GROUP BY c_custkey) AS t GROUP BY c_count""")
sql_query("tpch_q14_promo", """
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1996-01-01'""")
sql_query("tpch_q17_small_quantity", """
SELECT round(sum(l_extendedprice) / 7.0, 4) AS yearly FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE l_quantity < (SELECT 0.4 * avg(l_quantity) FROM {lineitem} WHERE l_partkey = p_partkey)""")
sql_query("tpch_q18_large_volume", """
SELECT c_custkey, o_orderkey, CAST(sum(l_quantity) AS BIGINT) AS qty FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 150) GROUP BY c_custkey, o_orderkey""")
sql_query("tpch_q22_no_orders", """
SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM {customer}
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'O') GROUP BY c_nationkey""")

# --- projection, filters, predicates ----------------------------------------------------------------------

sql_query("select_columns_alias", "SELECT n_nationkey AS k, n_name AS name, n_regionkey + 1 AS r1 FROM {nation}")
sql_query("filter_three_valued", "SELECT o_orderkey FROM {orders} WHERE NOT (nullif(o_orderstatus, 'F') = 'O') OR (o_totalprice > 100000 AND NULL IS NULL)")
sql_query("filter_comparisons", "SELECT p_partkey FROM {part} WHERE p_size >= 10 AND p_size <= 20 AND p_size <> 15 AND p_size != 16 AND NOT p_size = 17")
sql_query("is_distinct_from", "SELECT o_orderkey, nullif(o_orderstatus, 'O') IS NOT DISTINCT FROM NULL AS is_o, nullif(o_orderstatus, 'O') IS DISTINCT FROM 'F' AS not_f FROM {orders}")
sql_query("null_tests", "SELECT count(*) AS n, count(CASE WHEN nullif(p_size, 5) IS NULL THEN 1 END) AS fives, count(nullif(p_size, 5)) AS others FROM {part}")
sql_query("is_true_false", "SELECT o_orderkey, (o_totalprice > 100000) IS TRUE AS t, (nullif(o_totalprice, o_totalprice) > 0) IS TRUE AS u, (nullif(o_totalprice, o_totalprice) > 0) IS NOT FALSE AS v FROM {orders}")
sql_query("between", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity BETWEEN 5 AND 7 AND l_discount NOT BETWEEN 0.02 AND 0.08")
sql_query("in_list", "SELECT c_custkey FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
sql_query("in_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)")
sql_query("not_in_with_null", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 4 THEN NULL ELSE r_regionkey END FROM {region})")
sql_query("not_in_without_null", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT r_regionkey FROM {region})")
sql_query("exists_correlated", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
sql_query("not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)")
sql_query("row_values", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_suppkey, l_linenumber) IN (SELECT s_suppkey, CAST(s_nationkey % 7 + 1 AS INT) FROM {supplier})")
sql_query("row_value_order", "SELECT o_orderkey FROM {orders} WHERE struct(o_custkey, o_orderkey) < struct(100L, 5000L)", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderkey) < (100, 5000)")
sql_query("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, CASE p_size % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS rest FROM {part}")
sql_query("scalar_subquery", "SELECT n_name, (SELECT count(*) FROM {customer} WHERE c_nationkey = n_nationkey) AS customers, (SELECT max(s_acctbal) FROM {supplier} WHERE s_nationkey = n_nationkey) AS best FROM {nation}")
sql_query("like_glob_regexp", "SELECT p_partkey, lower(p_name) LIKE '%a_e%' AS l, p_name RLIKE '^[a-m].*[aeiou]$' AS r FROM {part}", "SELECT p_partkey, lower(p_name) LIKE '%a_e%' AS l, regexp_matches(p_name, '^[a-m].*[aeiou]$') AS r FROM part")
sql_query("concat_operator", "SELECT n_name || '-' || CAST(n_regionkey AS STRING) AS label FROM {nation}")
sql_query("bit_operators", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, ~p_partkey AS inv, shiftleft(p_partkey, 2) AS l, shiftright(p_partkey, 1) AS r FROM {part}", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, ~p_partkey AS inv, p_partkey << 2 AS l, p_partkey >> 1 AS r FROM part")
sql_query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")
sql_query("limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5")
sql_query("order_nulls_last", "SELECT k, r FROM (SELECT n_nationkey AS k, CAST(row_number() OVER (ORDER BY nullif(n_regionkey, 2) DESC NULLS LAST, n_nationkey) AS BIGINT) AS r FROM {nation}) t")
sql_query("order_nulls_default", "SELECT n_nationkey AS k, CAST(row_number() OVER (ORDER BY nullif(n_regionkey, 2), n_nationkey) AS BIGINT) AS r FROM {nation}", "SELECT n_nationkey AS k, row_number() OVER (ORDER BY nullif(n_regionkey, 2) NULLS FIRST, n_nationkey) AS r FROM nation")
sql_query("top_k", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
sql_query("values_rows", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
sql_query("literals", "SELECT 7 + 5 AS twelve, 'ab' || 'cd' AS abcd, 2 + 3 * 4 AS fourteen, hex(X'00ff') AS blob, r_regionkey FROM {region}", "SELECT 7 + 5 AS twelve, 'ab' || 'cd' AS abcd, 2 + 3 * 4 AS fourteen, '00FF' AS blob, r_regionkey FROM region")


@query("bind_parameters", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 40 AND o_orderstatus = 'O'")
def bind_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_custkey BETWEEN :low AND :high AND o_orderstatus = :status", args={"low": 10, "high": 40, "status": "O"}, orders=table(spark, sf_dir, "orders"))


@query("collate_nocase", "SELECT lower(c_mktsegment) AS seg, count(*) AS n FROM customer WHERE lower(c_mktsegment) IN ('building', 'furniture') GROUP BY 1")
def collate_nocase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case-insensitive comparison and grouping by collation."""
    rows = table(spark, sf_dir, "customer").withColumn("seg", F.collate("c_mktsegment", "UTF8_LCASE"))
    found = rows.filter(F.col("seg").isin("building", "FURNITURE")).groupBy("seg").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.lower(F.collate("seg", "UTF8_BINARY")).alias("seg"), "n")


@query("lenient_casts", "SELECT p_partkey, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS num, 0 AS none, 12 AS prefix, 1.5 AS real_prefix FROM part")
def lenient_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.concat(F.regexp_extract("p_brand", r"([0-9]+)", 1), F.lit("xyz"))
    return table(spark, sf_dir, "part").select("p_partkey", S.to_integer(digits).alias("num"), S.to_integer(F.lit("abc")).cast("int").alias("none"), S.to_integer(F.lit(" 12abc")).cast("int").alias("prefix"), S.to_real(F.lit("1.5e")).alias("real_prefix"))


@query("division_and_modulo", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 3 = 0 THEN NULL ELSE (l_orderkey // (l_linenumber - 3)) END AS q, CASE WHEN l_linenumber - 3 = 0 THEN NULL ELSE (-l_orderkey) % (l_linenumber - 3) END AS m FROM lineitem")
def division_and_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.col("l_linenumber") - 3).cast("bigint")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.divide(F.col("l_orderkey"), d).alias("q"), S.remainder(-F.col("l_orderkey"), d).alias("m"))


@query("shifts", "SELECT p_partkey, CASE WHEN p_size - 25 >= 0 THEN (p_partkey << (p_size - 25)) ELSE (p_partkey >> (25 - p_size)) END AS shifted FROM part")
def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.shift_left(F.col("p_partkey"), F.col("p_size") - 25).alias("shifted"))


@query("overflow_to_real", "SELECT o_orderkey, CASE WHEN o_orderkey <= 807 THEN CAST(CAST(9223372036854775000 AS HUGEINT) + o_orderkey AS DOUBLE) ELSE CAST(9223372036854775000 AS DOUBLE) + CAST(o_orderkey AS DOUBLE) END AS s FROM orders")
def overflow_to_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.add_or_real(F.lit(9223372036854775000), F.col("o_orderkey")).alias("s"))


# --- joins --------------------------------------------------------------------------------------------------

sql_query("join_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_nationkey = 7")
sql_query("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 250000")
sql_query("join_right", "SELECT n_name, r_name FROM {region} RIGHT JOIN {nation} ON r_regionkey = n_regionkey AND r_regionkey < 3")
sql_query("join_full", "SELECT s_suppkey, c_custkey FROM {supplier} FULL JOIN {customer} ON s_suppkey = c_custkey")
sql_query("join_cross", "SELECT r_name, n FROM {region} CROSS JOIN (VALUES (1), (2)) AS t(n)")
sql_query("join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM {nation}) x JOIN (SELECT s_suppkey AS k, s_name AS b FROM {supplier}) y USING (k)")
sql_query("join_full_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM {nation}) x FULL JOIN (SELECT s_suppkey + 10 AS k, s_name AS b FROM {supplier}) y USING (k)")
sql_query("join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM {nation}) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM {region}) y")


@query("join_theta_range", "SELECT count(*) AS n, CAST(sum(a.p_partkey) AS BIGINT) AS s FROM part a JOIN part b ON a.p_size BETWEEN b.p_size - 1 AND b.p_size + 1 AND a.p_partkey < b.p_partkey")
def join_theta_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.band_pairs(table(spark, sf_dir, "part"), "p_size", "p_partkey")


sql_query("intersect_all", "SELECT p_size AS k FROM {part} INTERSECT ALL SELECT s_nationkey AS k FROM {supplier}", "SELECT k FROM (SELECT p_size AS k, row_number() OVER (PARTITION BY p_size) AS n FROM part) a WHERE n <= (SELECT count(*) FROM supplier WHERE s_nationkey = k)")
sql_query("except_all", "SELECT p_size AS k FROM {part} EXCEPT ALL SELECT s_nationkey AS k FROM {supplier}", "SELECT k FROM (SELECT p_size AS k, row_number() OVER (PARTITION BY p_size) AS n FROM part) a WHERE n > (SELECT count(*) FROM supplier WHERE s_nationkey = k)")
sql_query("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query("join_parenthesised", "SELECT c_custkey, o_orderkey, l_linenumber FROM {customer} LEFT JOIN ({orders} JOIN {lineitem} ON o_orderkey = l_orderkey AND l_quantity > 48) ON c_custkey = o_custkey")
sql_query("join_semi", "SELECT p_partkey FROM {part} LEFT SEMI JOIN {lineitem} ON p_partkey = l_partkey AND l_quantity > 45", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE p_partkey = l_partkey AND l_quantity > 45)")
sql_query("join_anti", "SELECT p_partkey FROM {part} LEFT ANTI JOIN {lineitem} ON p_partkey = l_partkey AND l_quantity > 45", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE p_partkey = l_partkey AND l_quantity > 45)")
sql_query("join_null_keys", "SELECT count(*) AS n FROM (SELECT nullif(n_regionkey, 1) AS k FROM {nation}) a JOIN (SELECT nullif(r_regionkey, 1) AS k FROM {region}) b ON a.k = b.k")
sql_query("join_mixed_types", "SELECT n_name, r_name FROM {nation} JOIN (SELECT CAST(r_regionkey AS STRING) AS rk, r_name FROM {region}) r ON n_regionkey = CAST(rk AS INT)")

# --- aggregation ----------------------------------------------------------------------------------------------

sql_query("group_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
sql_query("group_expression_ordinal", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, o_orderstatus AS s, count(*) AS n FROM {orders} GROUP BY 1, 2")
sql_query("count_fast", "SELECT count(*) AS n FROM {lineitem}")
sql_query("count_union_view", "SELECT count(*) AS n FROM (SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}) t")
sql_query("min_max", "SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, substr(CAST(min(l_shipdate) AS STRING), 1, 10) AS first_day FROM {lineitem}")
sql_query("distinct_aggregates", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM {lineitem} GROUP BY l_returnflag")
sql_query("filter_clause", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 4) AS urgent FROM {orders} GROUP BY o_orderstatus")
sql_query("ordered_group_concat", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
sql_query("within_group", "SELECT o_orderstatus, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) AS q FROM orders GROUP BY o_orderstatus")
sql_query("nested_aggregate", "SELECT n_name, (SELECT count(*) FROM {customer} WHERE c_nationkey = n_nationkey HAVING count(*) > 50) AS many FROM {nation}")
sql_query("empty_aggregates", "SELECT count(*) AS n, sum(p_size) AS s, max(p_name) AS m FROM {part} WHERE p_size < 0", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, max(p_name) AS m FROM part WHERE p_size < 0")
sql_query("cube_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
sql_query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("aggregate_total", "SELECT n_regionkey, CAST(coalesce(sum(nullif(n_nationkey, n_nationkey)), 0) AS DOUBLE) AS none, CAST(sum(n_nationkey) AS DOUBLE) AS all_ FROM nation GROUP BY n_regionkey")
def aggregate_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.total(F.nullif(k, k)).alias("none"), A.total(k).alias("all_"))


@query("aggregate_group_concat", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def aggregate_group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.group_concat(F.col("n_name"), ", ", F.col("n_nationkey")).alias("names"))


@query("aggregate_median_percentile", "SELECT o_orderstatus, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus")
def aggregate_median_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(F.median(x), 4).alias("med"), F.round(A.percentile(x, 90), 4).alias("p90"))


@query("aggregate_percentile_disc", "SELECT l_returnflag, list_sort(list(l_extendedprice))[CAST(floor(0.3 * (count(*) - 1)) AS BIGINT) + 1] AS p30 FROM lineitem GROUP BY l_returnflag")
def aggregate_percentile_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.percentile_disc_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.3, "p30")


@query("bare_columns_with_max", "SELECT c_nationkey, max(c_acctbal) AS top, arg_max(c_custkey, c_acctbal) AS who FROM customer GROUP BY c_nationkey")
def bare_columns_with_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("top"), A.at_extreme(F.col("c_custkey"), F.col("c_acctbal")).alias("who"))


@query("decimal_sum", "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE) AS s FROM orders GROUP BY o_orderstatus")
def decimal_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(A.decimal_sum(text, 2).cast("double").alias("s"))


@query("geopoly_group_bbox", "SELECT c_nationkey, min(c_custkey) AS min_x, min(c_acctbal) AS min_y, max(c_custkey) AS max_x, max(c_acctbal) AS max_y FROM customer GROUP BY c_nationkey")
def geopoly_group_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(A.bounding_box(F.col("c_custkey"), F.col("c_acctbal")).alias("b")).select("c_nationkey", "b.*")


# --- set operations, CTEs, recursion -------------------------------------------------------------------------

sql_query("union_all", "SELECT n_regionkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}")
sql_query("union_distinct", "SELECT n_regionkey AS k FROM {nation} UNION SELECT CAST(p_size AS INT) FROM {part}")
sql_query("intersect", "SELECT o_custkey AS k FROM {orders} INTERSECT SELECT c_custkey FROM {customer} WHERE c_acctbal < 0")
sql_query("except_distinct", "SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal < 5000")
sql_query("compound_left_associative", "(SELECT n_nationkey AS k FROM {nation} UNION SELECT r_regionkey + 20 FROM {region}) INTERSECT SELECT s_suppkey FROM {supplier}")
sql_query("compound_order_limit", "SELECT k FROM (SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}) t ORDER BY k DESC LIMIT 12")
sql_query("cte", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")
sql_query("cte_recursive_series", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 90) SELECT n, n * n AS sq FROM t")
sql_query("cte_recursive_join", """WITH RECURSIVE up(k, depth) AS (SELECT n_nationkey, 0 FROM {nation} WHERE n_nationkey = 24 UNION ALL SELECT CAST(n_nationkey AS INT), depth + 1 FROM up JOIN {nation} ON n_nationkey = (k - 1) DIV 2 WHERE k > 0) SELECT k, depth FROM up""",
          """WITH RECURSIVE up(k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 24 UNION ALL SELECT n_nationkey, depth + 1 FROM up JOIN nation ON n_nationkey = (k - 1) // 2 WHERE k > 0) SELECT k, depth FROM up""")


@query("recursion_distinct_cycle", "WITH RECURSIVE t(k) AS (SELECT 1 UNION SELECT (k * 2) % 7 FROM t) SELECT k FROM t")
def recursion_distinct_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WITH RECURSIVE .. UNION over a cycle."""
    return R.distinct_recursion(spark.createDataFrame([(1,)], "k int"), lambda t: t.select((F.col("k") * 2 % 7).cast("int").alias("k")), 200)


@query("transitive_closure", """WITH RECURSIVE edge AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey > 2),
t(root, id, depth) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT), 0 UNION ALL SELECT root, child, depth + 1 FROM t JOIN edge ON parent = id WHERE depth < 5) SELECT root, id, min(depth) AS depth FROM t GROUP BY root, id""")
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "customer").filter("c_custkey > 2").select(F.col("c_custkey").alias("child"), F.expr("c_custkey DIV 3").alias("parent"))
    return R.closure(edges, "parent", "child", spark.createDataFrame([(1,)], "root bigint"), 5)


# --- changes to tables ---------------------------------------------------------------------------------------

_NEW = "SELECT n_nationkey + 20 AS n_nationkey, 'NEW' AS n_name, 9 AS n_regionkey FROM nation WHERE n_nationkey < 10"


def _new(nation: DataFrame) -> DataFrame:
    return nation.filter("n_nationkey < 10").select((F.col("n_nationkey") + 20).cast("int").alias("n_nationkey"), F.lit("NEW").alias("n_name"), F.lit(9).alias("n_regionkey"))


@query("insert_or_ignore", f"SELECT * FROM nation UNION ALL SELECT * FROM ({_NEW}) t WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return C.insert_or_ignore(nation, _new(nation), ["n_nationkey"])


@query("insert_or_replace", f"SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM ({_NEW}) t) UNION ALL {_NEW}")
def insert_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return C.insert_or_replace(nation, _new(nation), ["n_nationkey"])


@query("upsert", f"SELECT coalesce(a.n_nationkey, b.n_nationkey) AS n_nationkey, CASE WHEN a.n_nationkey IS NULL THEN b.n_name ELSE a.n_name END AS n_name, CASE WHEN a.n_nationkey IS NOT NULL AND b.n_nationkey IS NOT NULL AND a.n_regionkey > 1 THEN a.n_regionkey + b.n_regionkey WHEN a.n_nationkey IS NOT NULL THEN a.n_regionkey ELSE b.n_regionkey END AS n_regionkey FROM nation a FULL JOIN ({_NEW}) b ON a.n_nationkey = b.n_nationkey")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return C.upsert(nation, _new(nation), ["n_nationkey"], {"n_regionkey": lambda old, new: old + new}, where=lambda old, new: old("n_regionkey") > 1)


# Rows of every region's nations with null keys and keys that the new rows repeat.
_OLD_NULLS = "SELECT CASE WHEN n_regionkey <> 1 THEN n_nationkey END AS k, n_name AS v, n_nationkey AS n FROM nation"
_REPEATS = "SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey + 10 END AS k, c_name AS v, c_custkey AS n FROM customer"


def _repeating(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf_dir, "nation").select(F.when(F.col("n_regionkey") != 1, F.col("n_nationkey")).alias("k"), F.col("n_name").alias("v"), F.col("n_nationkey").alias("n"))
    new = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey") + 10).alias("k"), F.col("c_name").alias("v"), F.col("c_custkey").alias("n"))
    return old, new


@query("insert_or_ignore_repeats", f"WITH o AS ({_OLD_NULLS}), r AS ({_REPEATS}), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS i FROM r) SELECT k, v, n FROM o UNION ALL SELECT k, v, n FROM f WHERE k IS NULL OR i = 1 AND k NOT IN (SELECT k FROM o WHERE k IS NOT NULL)")
def insert_or_ignore_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _repeating(spark, sf_dir)
    return C.insert_or_ignore(old, new, ["k"], order=F.col("n"))


@query("insert_returning", f"WITH o AS ({_OLD_NULLS}), r AS ({_REPEATS}), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS i FROM r) SELECT k, v, n FROM f WHERE k IS NULL OR i = 1 AND k NOT IN (SELECT k FROM o WHERE k IS NOT NULL)")
def insert_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _repeating(spark, sf_dir)
    return C.inserted(old, new, ["k"], order=F.col("n"))


@query("insert_or_replace_repeats", f"WITH o AS ({_OLD_NULLS}), r AS ({_REPEATS}), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS i FROM r) SELECT k, v, n FROM o WHERE k IS NULL OR k NOT IN (SELECT k FROM r WHERE k IS NOT NULL) UNION ALL SELECT k, v, n FROM f WHERE k IS NULL OR i = 1")
def insert_or_replace_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _repeating(spark, sf_dir)
    return C.insert_or_replace(old, new, ["k"], order=F.col("n"))


@query("upsert_null_keys", f"WITH o AS ({_OLD_NULLS}), f AS (SELECT k, min(n) AS n FROM ({_REPEATS}) r WHERE k IS NOT NULL GROUP BY k) SELECT coalesce(o.k, f.k) AS k, o.v AS v, coalesce(o.n, 0) + coalesce(f.n, 0) AS n FROM o FULL JOIN f ON o.k = f.k")
def upsert_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _repeating(spark, sf_dir)
    least = new.filter("k is not null").groupBy("k").agg(F.min("n").alias("n"))
    return C.upsert(old, least, ["k"], {"n": lambda a, b: a + b})


@query("update_returning", "SELECT s_suppkey, 0 AS s_acctbal FROM supplier WHERE s_acctbal < 0")
def update_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.update_returning(table(spark, sf_dir, "supplier"), F.col("s_acctbal") < 0, {"s_acctbal": F.lit(0)}).select("s_suppkey", "s_acctbal")


@query("division_limits", "SELECT CAST(l_orderkey AS BIGINT) AS k, (9223372036854775807 - l_orderkey) // (l_linenumber - 3 + CASE WHEN l_linenumber = 3 THEN NULL ELSE 0 END) AS d, CASE WHEN l_linenumber % 2 = 0 THEN 9223372036854775807 ELSE -9223372036854775808 END AS i FROM lineitem WHERE l_linenumber < 3 OR l_linenumber > 3")
def division_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber <> 3")
    big = F.lit(2**63 - 1) - F.col("l_orderkey")
    digits = F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.lit("")).otherwise(F.lit("-")), F.lit("99999999999999999999 and more"))
    return lines.select(F.col("l_orderkey").cast("bigint").alias("k"), S.divide(big, F.col("l_linenumber") - 3).alias("d"), S.to_integer(digits).alias("i"))


@query("update_rows", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.update(table(spark, sf_dir, "customer"), F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)}).select("c_custkey", "c_acctbal")


@query("update_from", "SELECT s_suppkey, coalesce(n_name, s_name) AS s_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) n ON s_nationkey = n_nationkey")
def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return C.update_from(table(spark, sf_dir, "supplier"), changes, ["s_nationkey"], {"s_name": "n_name"}).select("s_suppkey", "s_name")


@query("delete_returning", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 300000")
def delete_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.delete(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 300000)[1].select("o_orderkey", "o_orderstatus")


@query("delete_order_limit", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 25)")
def delete_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.delete_first(table(spark, sf_dir, "part"), F.col("p_size") > 10, [F.desc("p_retailprice"), F.col("p_partkey")], 25, ["p_partkey"]).select("p_partkey")


@query("foreign_key_audit", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def foreign_key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.orphans(table(spark, sf_dir, "lineitem"), "l_suppkey", table(spark, sf_dir, "supplier").filter("s_acctbal > 0"), "s_suppkey").select("l_orderkey", "l_linenumber")


@query("unique_audit", "SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def unique_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicates(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("generated_columns", "SELECT p_partkey, p_size * 10 AS w, 'integer' AS x, substr(p_name, 2, 3) AS y FROM part")
def generated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10).alias("w"), S.type_name(F.col("p_size")).alias("x"), S.substr(F.col("p_name"), 2, 3).alias("y"))


@query("view_with_columns", "SELECT r_regionkey AS a, r_name AS b FROM region WHERE r_regionkey > 1")
def view_with_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").toDF("a", "b").filter("a > 1")


# --- sources ------------------------------------------------------------------------------------------------


@query("generate_series", "SELECT CAST(range AS BIGINT) AS value FROM range(0, 101, 5)")
def generate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.generate_series(spark, 0, 100, 5)


@query("generate_series_down", "SELECT CAST(-range AS BIGINT) AS value FROM range(0, 101, 5)")
def generate_series_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.generate_series(spark, 0, -100, -5)


@query("generate_series_lateral", "SELECT n_nationkey, CAST(unnest(range(n_regionkey, n_nationkey + 1, 3)) AS BIGINT) AS value FROM nation")
def generate_series_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.series_of(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "3").select("n_nationkey", "value")


@query("generate_series_source", "SELECT CAST(range AS BIGINT) AS value FROM range(3, 1000, 7)")
def generate_series_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the data source interface."""
    spark.dataSource.register(X.SeriesSource)
    return spark.read.format("series").option("start", 3).option("stop", 999).option("step", 7).load()


@query("wholenumber", "SELECT CAST(range AS BIGINT) AS value FROM range(5, 31)")
def wholenumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.wholenumber(spark, 5, 30)


@query("csv_text", "SELECT * FROM (VALUES ('1', 'a,b', 'x\"y'), ('2', '', 'z')) t(c1, c2, c3)")
def csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.csv_rows(spark, data='1,"a,b","x""y"\n2,,z\n')


@query("bound_array", "SELECT o_orderkey FROM orders WHERE o_custkey IN (3, 5, 8, 13)")
def bound_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = X.bound_values(spark, [3, 5, 8, 13])
    return table(spark, sf_dir, "orders").join(values, F.col("o_custkey") == F.col("value"), "left_semi").select("o_orderkey")


@query("union_of_ranges", "SELECT o_orderkey FROM orders")
def union_of_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return X.union_tables((orders, None, 499), (orders, 500, None), key="o_orderkey")


@query("index_range_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 50 AND 80 AND l_quantity > 10")
def index_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seek is a filter that reaches the Parquet scan."""
    return table(spark, sf_dir, "lineitem").filter("l_orderkey between 50 and 80 and l_quantity > 10").select("l_orderkey", "l_linenumber", "l_quantity")


@query("rowid_lookup", "SELECT * FROM nation WHERE n_nationkey = 7")
def rowid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").filter("n_nationkey = 7")


@query("rtree_box", "SELECT c_custkey FROM customer WHERE c_custkey BETWEEN 100 AND 600 AND c_acctbal BETWEEN 0 AND 3000")
def rtree_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(F.col("c_custkey").between(100, 600) & F.col("c_acctbal").between(0, 3000)).select("c_custkey")


def _queue(name: str, order: str, depth_first: bool) -> None:
    """A recursion with ORDER BY and LIMIT over the customers, each below the one of a third of its number."""

    @query(name, f"""WITH RECURSIVE edge AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey > 2),
t(id, depth, path) AS (SELECT CAST(1 AS BIGINT), 0, [CAST(1 AS BIGINT)] UNION ALL SELECT child, depth + 1, list_append(path, child) FROM t JOIN edge ON parent = id) SELECT id, depth FROM t ORDER BY {order} LIMIT 25""")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = table(spark, sf_dir, "customer").filter("c_custkey > 2").select(F.col("c_custkey").alias("child"), F.expr("c_custkey DIV 3").alias("parent"))
        return R.walk(edges, "parent", "child", spark.createDataFrame([(1,)], "root bigint"), depth_first).select("id", "depth").limit(25)


_queue("recursion_depth_first", "path", True)
_queue("recursion_breadth_first", "depth, path", False)
sql_query("cte_nested_with", "WITH a AS (WITH b AS (SELECT n_regionkey AS k, count(*) AS n FROM {nation} GROUP BY n_regionkey) SELECT k, n FROM b WHERE k > 0) SELECT r_name, n FROM a JOIN {region} ON k = r_regionkey")
