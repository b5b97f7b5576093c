"""Queries for sinks, typed ingestion, table alterations, binary JSON and further search functions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import affinity as A
from ..functions import extras as X
from ..functions import json_text as J
from ..functions import scalar as S
from ..operators import search as Q
from ..sources import tables as T
from .registry import query
from .tables import sql_query, table


def _folder(spark: SparkSession) -> str:
    """A new folder below the one that executors share; a temporary one in local sessions."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='quillon-')}/{uuid.uuid4().hex}"


@query("sink_create_table_as", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def sink_create_table_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS: written, read back."""
    path = _folder(spark)
    table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.parquet(path)


@query("sink_insert_select", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def sink_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT INTO .. SELECT: an append to a table."""
    path = _folder(spark)
    table(spark, sf_dir, "region").toDF("k", "name").write.parquet(path)
    table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("sink_partitioned", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey IN (3, 4) GROUP BY c_nationkey")
def sink_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in a folder per key: a filter on the key reads only its folders."""
    path = _folder(spark)
    table(spark, sf_dir, "customer").repartition("c_nationkey").write.partitionBy("c_nationkey").parquet(path)
    return spark.read.parquet(path).filter("c_nationkey in (3, 4)").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("source_csv_file", "SELECT CAST(n_nationkey AS VARCHAR) AS c1, n_name || ', \"x\"' AS c2 FROM nation")
def source_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted fields with commas and quotes, written and read."""
    path = _folder(spark)
    nation = table(spark, sf_dir, "nation")
    nation.select("n_nationkey", F.concat("n_name", F.lit(', "x"')).alias("t")).write.option("escape", '"').csv(path)
    return T.csv_rows(spark, path)


@query("source_zip_round_trip", "SELECT n_name AS name, CAST(length(n_name) AS BIGINT) AS sz FROM nation")
def source_zip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of each region's nations, opened again."""
    import io
    import zipfile

    import pandas as pd

    nation = table(spark, sf_dir, "nation")
    archives = nation.groupBy("n_regionkey").agg(T.zip_bytes(F.col("n_name"), F.encode("n_name", "UTF-8")).alias("z"))

    def members(batches):
        for pdf in batches:
            rows = []
            for content in pdf["z"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(i.filename, i.file_size) for i in z.infolist()]
            yield pd.DataFrame(rows, columns=["name", "sz"])

    return archives.select("z").mapInPandas(members, "name string, sz long")


@query("typed_ingest", "SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS r, p_name AS t, CAST(NULL AS BIGINT) AS bad FROM part")
def typed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.concat(F.lit(" "), "p_partkey", F.lit(".0")).alias("i"), F.col("p_size").cast("string").alias("r"), F.col("p_name").alias("t"), F.lit("x1").alias("bad"))
    return A.ingest(part, {"i": "BIGINT", "r": "DOUBLE PRECISION", "t": "VARCHAR(9)", "bad": "INT"})


@query("mixed_type_order", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY CASE WHEN n_regionkey = 0 THEN 0 WHEN n_regionkey = 1 THEN 2 ELSE 1 END, CASE WHEN n_regionkey > 1 THEN -n_nationkey END, CASE WHEN n_regionkey = 1 THEN n_name END, n_nationkey) AS BIGINT) AS r FROM nation")
def mixed_type_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, numbers and texts of one column in one order."""
    from pyspark.sql.window import Window

    kind = F.col("n_regionkey")
    key = A.mixed_key(F.when(kind == 0, 0).when(kind == 1, 2).otherwise(1), F.when(kind > 1, -F.col("n_nationkey").cast("double")), F.when(kind == 1, F.col("n_name")), F.lit(None).cast("binary"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(key, "n_nationkey")).cast("bigint").alias("r"))


@query("alter_table", "SELECT n_nationkey AS id, n_name, n_regionkey * 2 AS twice FROM nation")
def alter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rename, add and drop columns."""
    return table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "id").withColumn("twice", F.col("n_regionkey") * 2).drop("n_regionkey")


sql_query("check_constraint_audit", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE NOT (l_quantity > 0 AND l_discount <= 0.09)")
sql_query("not_null_audit", "SELECT count(*) AS n FROM {orders} WHERE o_custkey IS NULL OR o_orderstatus IS NULL")
sql_query("analyze_counts", "SELECT count(*) AS n, count(DISTINCT c_nationkey) AS k, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM {customer}")


@query("jsonb_variant", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.k' AS t, NULL AS missing FROM events")
def jsonb_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary JSON: parsed once, read by path."""
    v = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("v"))
    return v.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.try_variant_get("v", "$.k", "string").alias("t"), F.try_variant_get("v", "$.none", "string").alias("missing"))


@query("jsonb_each", "SELECT event_id, 'k' AS key, props->>'$.k' AS value FROM events")
def jsonb_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("v"))
    return spark.sql("SELECT event_id, t.key, CAST(t.value AS STRING) AS value FROM {events}, LATERAL variant_explode(v) AS t(pos, key, value)", events=events)


@query("json_pretty_insert", "SELECT n_nationkey, '{' || chr(10) || '  \"n\": ' || n_nationkey || chr(10) || '}' AS p, '[1,' || n_nationkey || ',2]' AS i, 'real' AS t FROM nation")
def json_pretty_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", J.json_pretty(F.concat(F.lit('{"n":'), k, F.lit("}")), F.lit("  ")).alias("p"), J.json_array_insert(F.lit("[1,2]"), F.lit("$[1]"), k).alias("i"), J.json_type(F.lit("[1.5]"), F.lit("$[0]")).alias("t"))


@query("fts_offsets", "SELECT doc_id, list_sort(list(pos)) AS places FROM (SELECT doc_id, unnest(list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'license'), lambda i: i - 1)) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents) d) p GROUP BY doc_id".replace("list_sort(list(pos)) AS places", "array_to_string(list_sort(list(pos)), ' ') AS places"))
def fts_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token places of a term in each document."""
    t = Q.tokens(table(spark, sf_dir, "documents"), "doc_id", "text").filter("term = 'license'")
    return t.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("pos")), " ").alias("places"))


@query("fts_matchinfo", "SELECT p_partkey, CAST(len(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS BIGINT) AS len, CAST(len(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda x: starts_with(x, 'b'))) AS BIGINT) AS hits FROM part")
def fts_matchinfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: tokens, and tokens that begin with a prefix."""
    w = Q.words(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(w).cast("bigint").alias("len"), F.size(F.filter(w, lambda t: t.startswith("b"))).cast("bigint").alias("hits"))


@query("decimal_text_functions", "SELECT o_orderkey, CAST(CAST(o_totalprice * 100 AS BIGINT) AS VARCHAR) AS cents, CAST(sign(o_totalprice - 100000) AS INT) AS cmp FROM orders")
def decimal_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(20,2)")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.decimal_text(F.round(price * 100, 0), 4).alias("cents"), F.signum(price - F.lit(100000)).cast("int").alias("cmp"))


@query("uuid_formats")
def uuid_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random identifiers as text and as 16 bytes: only their shape can be checked."""
    u = F.uuid()
    return table(spark, sf_dir, "region").select("r_regionkey", u.alias("text")).withColumn("blob", F.unhex(F.replace("text", F.lit("-"), F.lit(""))))


@query("sha1_query", "SELECT upper(sha1(string_agg(n_name, '' ORDER BY n_nationkey))) AS h FROM nation")
def sha1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a whole ordered result."""
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return table(spark, sf_dir, "nation").agg(F.upper(F.sha1(F.array_join(F.transform(rows, lambda r: r["n_name"]), ""))).alias("h"))


@query("regexp_ignore_case", "SELECT p_partkey, regexp_matches(p_brand, 'brand#[12]', 'i') AS m FROM part")
def regexp_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.regexp("brand#[12]", F.col("p_brand"), ignore_case=True).alias("m"))


@query("weighted_fuzzy_match", "SELECT n_nationkey FROM nation WHERE n_name IN ('NATION_1', 'NATION_7')")
def weighted_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacing 1 by 7 is cheap, anything else is not."""
    d = X.weighted_distance(F.col("n_name"), F.lit("NATION_7"), costs={("1", "7"): 10})
    return table(spark, sf_dir, "nation").filter(d <= 20).select("n_nationkey")
