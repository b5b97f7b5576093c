"""Queries for scalar, mathematical, date and JSON functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import extras as X
from ..functions import json_text as J
from ..functions import scalar as S
from ..functions import user as U
from .registry import query
from .tables import table


def _select(name: str, base: str, key: str, oracle: str, **columns):
    """Register key and columns over a table; columns are built when the query runs."""

    @query(name, f"SELECT {key}, {oracle} FROM {base}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, base).select(key, *[make().alias(n) for n, make in columns.items()])


c = F.col
_select("text_case_trim", "part", "p_partkey", "upper(p_name) AS u, lower(p_brand) AS l, trim('  ' || p_name || ' ') AS t, ltrim('xx' || p_name, 'x') AS lt, rtrim(p_name || 'yz', 'zy') AS rt, trim('ab' || p_name || 'ba', 'ab') AS b",
        u=lambda: S.upper(c("p_name")), l=lambda: S.lower(c("p_brand")), t=lambda: F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))), lt=lambda: F.ltrim(F.concat(F.lit("xx"), "p_name"), F.lit("x")), rt=lambda: F.rtrim(F.concat("p_name", F.lit("yz")), F.lit("zy")), b=lambda: F.trim(F.concat(F.lit("ab"), "p_name", F.lit("ba")), F.lit("ab")))
_select("text_length_instr", "part", "p_partkey", "CAST(length(p_name) AS BIGINT) AS n, CAST(strlen(p_name) AS BIGINT) AS o, CAST(instr(p_name, 'a') AS BIGINT) AS i, CAST(unicode(p_name) AS BIGINT) AS u, replace(p_name, 'a', '<A>') AS r",
        n=lambda: F.length("p_name").cast("bigint"), o=lambda: F.octet_length("p_name").cast("bigint"), i=lambda: F.instr("p_name", "a").cast("bigint"), u=lambda: S.unicode(c("p_name")).cast("bigint"), r=lambda: F.replace(c("p_name"), F.lit("a"), F.lit("<A>")))
_select("text_substr", "part", "p_partkey", "substr(p_name, 2, 3) AS a, substr(p_name, -3) AS b, substr(p_name, 1, 1) AS c, substr(p_name, length(p_name) - 3, 2) AS d, substr(p_name, 4) AS e, substr(p_name, 1, 1) AS f",
        a=lambda: S.substr(c("p_name"), 2, 3), b=lambda: S.substr(c("p_name"), -3), c=lambda: S.substr(c("p_name"), 0, 2), d=lambda: S.substr(c("p_name"), -2, -2), e=lambda: S.substr(c("p_name"), 4), f=lambda: S.substr(c("p_name"), 2, -1))
_select("text_concat", "orders", "o_orderkey", "concat(o_orderstatus, NULL, '-', o_orderpriority) AS a, concat_ws('/', o_orderstatus, NULL, o_orderpriority) AS b, concat(nullif(o_orderstatus, 'F'), 'x') AS d",
        a=lambda: S.concat(c("o_orderstatus"), F.lit(None), F.lit("-"), c("o_orderpriority")), b=lambda: F.concat_ws("/", "o_orderstatus", F.lit(None).cast("string"), "o_orderpriority"), d=lambda: S.concat(F.nullif(c("o_orderstatus"), F.lit("F")), F.lit("x")))
_select("text_quote_hex", "nation", "n_nationkey", "'''' || replace(n_name, '''', '''''') || '''' AS q, CAST(n_nationkey AS VARCHAR) AS qn, hex(n_name) AS h, hex(CAST(n_nationkey AS VARCHAR)) AS hn, n_name AS back, 'NULL' AS qnull",
        q=lambda: S.quote(c("n_name")), qn=lambda: S.quote(c("n_nationkey"), "number"), h=lambda: S.hex(c("n_name")), hn=lambda: S.hex(c("n_nationkey")), back=lambda: S.unhex(F.hex("n_name")).cast("string"), qnull=lambda: S.quote(F.lit(None).cast("string")))
_select("text_char_zeroblob", "nation", "n_nationkey", "chr(65 + n_nationkey) || chr(8364) || chr(128512) AS s, repeat('00', n_nationkey) AS z",
        s=lambda: S.char(c("n_nationkey") + 65, F.lit(8364), F.lit(128512)), z=lambda: F.hex(S.zeroblob(c("n_nationkey"))))
_select("text_like_escape", "part", "p_partkey", "p_name ILIKE '%A_E%' AS a, (p_name || '%') LIKE '%!%' ESCAPE '!' AS b, p_name GLOB '[a-m]*e*' AS g, p_name GLOB '?[!aeiou]*' AS h, regexp_matches(p_name, '[aeiou]{2}') AS r",
        a=lambda: S.like(c("p_name"), "%A_E%"), b=lambda: S.like(F.concat("p_name", F.lit("%")), "%!%", "!"), g=lambda: S.glob(c("p_name"), "[a-m]*e*"), h=lambda: S.glob(c("p_name"), "?[^aeiou]*"), r=lambda: S.regexp("[aeiou]{2}", c("p_name")))
_select("conditionals", "orders", "o_orderkey", "coalesce(nullif(o_orderstatus, 'F'), 'none') AS a, ifnull(nullif(o_orderstatus, 'O'), '-') AS b, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS d",
        a=lambda: F.coalesce(F.nullif(c("o_orderstatus"), F.lit("F")), F.lit("none")), b=lambda: F.ifnull(F.nullif(c("o_orderstatus"), F.lit("O")), F.lit("-")), d=lambda: S.iif(c("o_totalprice") > 200000, F.lit("big"), c("o_totalprice") > 100000, F.lit("mid"), F.lit("low")))
_select("scalar_min_max", "part", "p_partkey", "CASE WHEN p_size = 5 THEN NULL ELSE least(p_size, p_partkey, 20) END AS lo, CASE WHEN p_size = 5 THEN NULL ELSE greatest(p_size, p_partkey, 20) END AS hi",
        lo=lambda: S.smallest(F.nullif(c("p_size"), F.lit(5)), c("p_partkey"), F.lit(20)), hi=lambda: S.largest(F.nullif(c("p_size"), F.lit(5)), c("p_partkey"), F.lit(20)))
_select("type_names", "events", "event_id", "'integer' AS i, 'real' AS r, CASE WHEN props IS NULL THEN 'null' ELSE 'text' END AS t, 'null' AS n, 'blob' AS b",
        i=lambda: S.type_name(c("user_id")), r=lambda: S.type_name(c("value")), t=lambda: S.type_name(c("props")), n=lambda: S.type_name(F.lit(None)), b=lambda: S.type_name(c("props").cast("binary")))
_select("planner_hints_are_identity", "part", "p_partkey", "p_size AS a, p_size AS b, p_size AS d", a=lambda: c("p_size"), b=lambda: c("p_size"), d=lambda: c("p_size"))
_select("rounding", "lineitem", "l_orderkey", "l_linenumber, round(l_extendedprice) AS r0, round(l_extendedprice / 7, 2) AS r2, ceil(l_extendedprice) AS ce, floor(-l_extendedprice) AS fl, trunc(-l_extendedprice) AS tr, abs(-l_quantity) AS ab, CAST(sign(l_discount - 0.05) AS INT) AS sg",
        l_linenumber=lambda: c("l_linenumber"), r0=lambda: F.round("l_extendedprice"), r2=lambda: F.round(c("l_extendedprice") / 7, 2), ce=lambda: F.ceil("l_extendedprice").cast("double"), fl=lambda: F.floor(-c("l_extendedprice")).cast("double"), tr=lambda: S.truncate(-c("l_extendedprice")), ab=lambda: F.abs(-c("l_quantity")), sg=lambda: S.sign(c("l_discount") - 0.05))
_select("logarithms_powers", "part", "p_partkey", "round(ln(p_size), 9) AS a, round(log10(p_size), 9) AS b, round(log2(p_size), 9) AS d, round(ln(p_retailprice) / ln(3), 9) AS e, round(exp(p_size / 10.0), 6) AS f, round(pow(p_size, 1.5), 6) AS g, round(sqrt(p_size), 9) AS h, NULL AS i, round(p_retailprice % 7.0, 6) AS m",
        a=lambda: F.round(F.ln("p_size"), 9), b=lambda: F.round(S.log(c("p_size")), 9), d=lambda: F.round(F.log2("p_size"), 9), e=lambda: F.round(S.log(c("p_retailprice"), F.lit(3)), 9), f=lambda: F.round(F.exp(c("p_size") / 10.0), 6), g=lambda: F.round(F.pow("p_size", F.lit(1.5)), 6), h=lambda: F.round(S.sqrt(c("p_size")), 9), i=lambda: S.sqrt(-c("p_size")), m=lambda: F.round(S.modulo(c("p_retailprice"), F.lit(7.0)), 6))
_select("trigonometry", "lineitem", "l_orderkey", "l_linenumber, round(sin(l_quantity), 9) AS s, round(cos(l_quantity), 9) AS co, round(tan(l_discount), 9) AS t, round(asin(l_discount), 9) AS a, round(acos(l_discount), 9) AS ac, round(atan(l_quantity), 9) AS at, round(atan2(l_quantity, l_discount + 1), 9) AS a2, round(degrees(l_discount), 9) AS d, round(radians(l_quantity), 9) AS r, round(pi(), 9) AS p",
        l_linenumber=lambda: c("l_linenumber"), s=lambda: F.round(F.sin("l_quantity"), 9), co=lambda: F.round(F.cos("l_quantity"), 9), t=lambda: F.round(F.tan("l_discount"), 9), a=lambda: F.round(S.asin(c("l_discount")), 9), ac=lambda: F.round(S.acos(c("l_discount")), 9), at=lambda: F.round(F.atan("l_quantity"), 9), a2=lambda: F.round(F.atan2(c("l_quantity"), c("l_discount") + 1), 9), d=lambda: F.round(F.degrees("l_discount"), 9), r=lambda: F.round(F.radians("l_quantity"), 9), p=lambda: F.round(F.pi(), 9))
_select("hyperbolics", "lineitem", "l_orderkey", "l_linenumber, round(sinh(l_discount), 9) AS s, round(cosh(l_discount), 9) AS co, round(tanh(l_discount), 9) AS t, round(asinh(l_quantity), 9) AS a, round(acosh(l_quantity), 9) AS ac, round(atanh(l_discount), 9) AS at",
        l_linenumber=lambda: c("l_linenumber"), s=lambda: F.round(F.sinh("l_discount"), 9), co=lambda: F.round(F.cosh("l_discount"), 9), t=lambda: F.round(F.tanh("l_discount"), 9), a=lambda: F.round(F.asinh("l_quantity"), 9), ac=lambda: F.round(S.acosh(c("l_quantity")), 9), at=lambda: F.round(S.atanh(c("l_discount")), 9))

# --- dates -------------------------------------------------------------------------------------------------

_select("date_parts", "orders", "o_orderkey", "strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt, CAST(epoch(o_orderdate) AS BIGINT) AS e, epoch(o_orderdate) / 86400.0 + 2440587.5 AS j",
        d=lambda: D.date(c("o_orderdate")), t=lambda: D.time(c("o_orderdate")), dt=lambda: D.datetime(c("o_orderdate")), e=lambda: D.unixepoch(c("o_orderdate")), j=lambda: D.julianday(c("o_orderdate")))
_select("date_modifiers_days", "orders", "o_orderkey", "strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS a, strftime(o_orderdate - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS b, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS y, strftime(o_orderdate + to_days(CAST((7 - dayofweek(o_orderdate)) % 7 AS INT)), '%Y-%m-%d') AS w",
        a=lambda: D.date(D.modified(c("o_orderdate"), "+10 days")), b=lambda: D.datetime(D.modified(c("o_orderdate"), "-90 minutes")), m=lambda: D.date(D.modified(c("o_orderdate"), "start of month")), y=lambda: D.date(D.modified(c("o_orderdate"), "start of year")), w=lambda: D.date(D.modified(c("o_orderdate"), "weekday 0")))
_select("date_modifiers_months", "orders", "o_orderkey", "strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INT)), '%Y-%m-%d') AS over, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS floor, strftime(date_trunc('month', o_orderdate) + INTERVAL 12 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INT)), '%Y-%m-%d') AS year, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS last",
        over=lambda: D.date(D.modified(c("o_orderdate"), "+1 month")), floor=lambda: D.date(D.modified(c("o_orderdate"), "+1 month", "floor")), year=lambda: D.date(D.modified(c("o_orderdate"), "+1 year")), last=lambda: D.date(D.modified(c("o_orderdate"), "start of month", "+1 month", "-1 day")))
_select("strftime", "orders", "o_orderkey", "strftime(o_orderdate, '%d|%H|%j|%m|%M|%S|%Y|%%|%u|%w|%V|%G') AS a, strftime(o_orderdate, 'on %Y/%m at %H:%M') AS b, strftime(o_orderdate, '%U-%W') AS wk, strftime(o_orderdate, '%I %p') AS h12, NULL AS bad",
        a=lambda: D.strftime("%d|%H|%j|%m|%M|%S|%Y|%%|%u|%w|%V|%G", c("o_orderdate")), b=lambda: D.strftime("on %Y/%m at %R", c("o_orderdate")), wk=lambda: D.strftime("%U-%W", c("o_orderdate")), h12=lambda: D.strftime("%I %p", c("o_orderdate")), bad=lambda: D.strftime("%Q", c("o_orderdate")))
_select("date_parse", "nation", "n_nationkey", "strftime(TIMESTAMP '2024-01-31 10:20:30' + to_days(n_nationkey), '%Y-%m-%d %H:%M:%S') AS a, NULL AS bad, '2000-01-01 07:08:00' AS clock, '2024-03-02' AS julian",
        a=lambda: D.datetime(D.parse(F.concat(F.date_format(F.date_add(F.lit("2024-01-31").cast("date"), c("n_nationkey")), "yyyy-MM-dd"), F.lit("T10:20:30")))), bad=lambda: D.datetime(D.parse(F.lit("2024-13-45"))), clock=lambda: D.datetime(D.parse(F.lit("07:08"))), julian=lambda: D.date(D.from_julian(F.lit(2460371.5))))
# From the first of a month on, months never overflow, so that plain calendar arithmetic is an oracle.
_LATER = "(o_orderdate + INTERVAL 400 DAY + INTERVAL 11045 SECOND)"
_FIRST = "date_trunc('month', o_orderdate)"
_SPAN = f"printf('%04d-%02d-%02d ', datesub('month', {_FIRST}, {_LATER}) // 12, datesub('month', {_FIRST}, {_LATER}) % 12, day({_LATER}) - 1) || strftime({_LATER}, '%H:%M:%S.%g')"
_select("timediff", "orders", "o_orderkey", f"'+' || {_SPAN} AS ahead, '-' || {_SPAN} AS back, '+0000-00-00 00:00:00.000' AS same",
        ahead=lambda: D.timediff(_later(), _first()), back=lambda: D.timediff(_first(), _later()), same=lambda: D.timediff(_first(), _first()))


def _later():
    return D.modified(c("o_orderdate"), "+400 days", "+11045 seconds")


def _first():
    return D.modified(c("o_orderdate"), "start of month")

# --- JSON --------------------------------------------------------------------------------------------------

_select("json_extract", "events", "event_id", "CAST(props->'$.k' AS BIGINT)::VARCHAR AS k, NULL AS missing, props->>'$.k' AS arrow, CAST(json_type(props) = 'OBJECT' AS BOOLEAN) AS obj",
        k=lambda: J.json_extract(c("props"), F.lit("$.k")), missing=lambda: J.json_extract(c("props"), F.lit("$.none")), arrow=lambda: F.get_json_object("props", "$.k"), obj=lambda: J.json_type(c("props")) == "object")
_select("json_edit", "events", "event_id", "'{\"k\":' || (props->>'$.k') || ',\"n\":' || user_id || '}' AS s, '{\"k\":0}' AS r, '{\"k\":' || (props->>'$.k') || '}' AS i, '{}' AS d, '{\"k\":' || (props->>'$.k') || ',\"z\":[1]}' AS p",
        s=lambda: J.json_set(c("props"), F.lit("$.n"), c("user_id")), r=lambda: J.json_replace(c("props"), F.lit("$.k"), F.lit(0)), i=lambda: J.json_insert(c("props"), F.lit("$.k"), F.lit(5)), d=lambda: J.json_remove(c("props"), F.lit("$.k")), p=lambda: J.json_patch(c("props"), F.lit('{"z":[1]}')))
_select("json_build", "nation", "n_nationkey", "'[' || n_nationkey || ',\"' || n_name || '\",null]' AS a, '{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS o, '\"' || n_name || '\"' AS q",
        a=lambda: J.json_array(c("n_nationkey"), c("n_name"), F.lit(None).cast("string")), o=lambda: J.json_object(id=c("n_nationkey"), name=c("n_name")), q=lambda: J.json_quote(c("n_name")))
_select("json_valid_type", "events", "event_id", "CAST(json_valid(props) AS INT) AS ok, 0 AS bad, 1 AS json5, CAST(2 AS BIGINT) AS len, 4 AS err, '{\"a\":[1,2]}' AS mini",
        ok=lambda: J.json_valid(c("props")), bad=lambda: J.json_valid(F.lit("{a:1}")), json5=lambda: J.json_valid(F.lit("{a:1}"), F.lit(2)), len=lambda: J.json_array_length(F.lit("[1,[2]]")), err=lambda: J.json_error_position(F.lit("[1,}")), mini=lambda: J.json_minified(F.lit("{a: [1, 2,], }")))


@query("json_group_array", "SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_nationkey) || ']' AS a, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey")
def json_group_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(J.json_group_array(c("n_name"), c("n_nationkey")).alias("a"), J.json_group_object(c("n_name"), c("n_nationkey")).alias("o"))


@query("json_each", "SELECT event_id, 'k' AS key, props->>'$.k' AS value, 'integer' AS type, '$.k' AS fullkey, '$' AS path FROM events")
def json_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(J.json_nodes(c("props"), deep=False)).alias("n"))
    return rows.select("event_id", "n.key", "n.value", "n.type", "n.fullkey", "n.path")


@query("json_tree", "SELECT event_id, unnest(['$', '$.a', '$.a[0]', '$.a[1]', '$.a[1].b']) AS fullkey, unnest(['object', 'array', 'integer', 'object', 'null']) AS type FROM events")
def json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"a":['), c("event_id"), F.lit(',{"b":null}]}'))
    return table(spark, sf_dir, "events").select("event_id", F.explode(J.json_nodes(text)).alias("n")).select("event_id", "n.fullkey", "n.type")


_select("json_arrow", "events", "event_id", "CAST(props->'$.k' AS VARCHAR) AS by_path, CAST(props->'$.k' AS VARCHAR) AS by_name, CAST(event_id AS VARCHAR) AS by_place, NULL AS missing, '{\"a\":\"x\"}' AS whole",
        by_path=lambda: J.json_arrow(c("props"), F.lit("$.k")), by_name=lambda: J.json_arrow(c("props"), F.lit("k")), by_place=lambda: J.json_arrow(F.concat(F.lit("[0,"), c("event_id"), F.lit("]")), F.lit("1")), missing=lambda: J.json_arrow(c("props"), F.lit("none")), whole=lambda: J.json_arrow(F.lit('{"b":{"a":"x"}}'), F.lit("$.b")))
_select("jsonb_edit", "events", "event_id", "'{\"k\":' || (props->>'$.k') || ',\"n\":' || user_id || '}' AS s, '{\"k\":0}' AS r, '{\"k\":' || (props->>'$.k') || '}' AS i, '{}' AS d, '{\"k\":' || (props->>'$.k') || ',\"z\":[1]}' AS p, '[1,' || event_id || ',2]' AS ai",
        s=lambda: F.to_json(J.jsonb_set(J.jsonb(c("props")), F.lit("$.n"), c("user_id"))), r=lambda: F.to_json(J.jsonb_replace(J.jsonb(c("props")), F.lit("$.k"), F.lit(0))), i=lambda: F.to_json(J.jsonb_insert(J.jsonb(c("props")), F.lit("$.k"), F.lit(5))),
        d=lambda: F.to_json(J.jsonb_remove(J.jsonb(c("props")), F.lit("$.k"))), p=lambda: F.to_json(J.jsonb_patch(J.jsonb(c("props")), F.lit('{"z":[1]}'))), ai=lambda: F.to_json(J.jsonb_array_insert(J.jsonb(F.lit("[1,2]")), F.lit("$[1]"), c("event_id"))))
_select("jsonb_build", "nation", "n_nationkey", "'[' || n_nationkey || ',\"' || n_name || '\",null]' AS a, '{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS o",
        a=lambda: F.to_json(J.jsonb_array(c("n_nationkey"), c("n_name"), F.lit(None).cast("string"))), o=lambda: F.to_json(J.jsonb_object(id=c("n_nationkey"), name=c("n_name"))))


@query("jsonb_group", "SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_nationkey) || ']' AS a, CAST(max(n_nationkey) AS BIGINT) AS top FROM nation GROUP BY n_regionkey")
def jsonb_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(J.jsonb_group_array(c("n_name"), c("n_nationkey")).alias("a"), J.jsonb_group_object(F.concat(F.lit("k"), "n_nationkey"), c("n_nationkey")).alias("o"))
    values = F.map_values(F.from_json(F.to_json("o"), "map<string,bigint>"))
    return groups.select("n_regionkey", F.to_json("a").alias("a"), F.array_max(values).alias("top"))


# --- a user's own functions ------------------------------------------------------------------------------------


@query("user_functions", "SELECT p_partkey, reverse(p_name) || '/' || p_size AS s, CAST(sum(p_size * p_size) OVER (PARTITION BY p_brand) AS BIGINT) AS squares FROM part")
def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function, and an aggregate over windows."""
    U.register_scalar(spark, "quillon_backwards", lambda a, b: None if a is None or b is None else f"{a[::-1]}/{b}", "string")
    U.register_aggregate(spark, "quillon_squares", lambda: 0, lambda s, v: s if v is None else s + v * v, int, "bigint")
    return spark.sql("SELECT p_partkey, quillon_backwards(p_name, p_size) AS s, quillon_squares(p_size) OVER (PARTITION BY p_brand) AS squares FROM {part}", part=table(spark, sf_dir, "part"))


@query("user_aggregate", "SELECT p_brand, CAST(sum(p_size * p_size) AS BIGINT) AS squares FROM part GROUP BY p_brand")
def user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    U.register_aggregate(spark, "quillon_squares", lambda: 0, lambda s, v: s if v is None else s + v * v, int, "bigint")
    return spark.sql("SELECT p_brand, quillon_squares(p_size) AS squares FROM {part} GROUP BY p_brand", part=table(spark, sf_dir, "part"))


@query("user_table_function", "SELECT n_nationkey, CAST(i AS INT) AS place, substr(n_name, CAST(i AS INT), 1) AS letter FROM nation, range(1, 100) r(i) WHERE i <= length(n_name)")
def user_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    U.register_table(spark, "quillon_letters", lambda text: enumerate(text or "", 1), "place int, letter string")
    return spark.sql("SELECT n_nationkey, t.place, t.letter FROM {nation}, LATERAL quillon_letters(n_name) t", nation=table(spark, sf_dir, "nation"))


# --- other functions -------------------------------------------------------------------------------------------

_select("hashes", "nation", "n_nationkey", "upper(sha1(n_name)) AS s1, upper(sha256(n_name)) AS s2, upper(md5(n_name)) AS m, to_base64(encode(n_name)) AS b",
        s1=lambda: F.upper(F.sha1("n_name")), s2=lambda: F.upper(F.sha2("n_name", 256)), m=lambda: F.upper(F.md5("n_name")), b=lambda: F.base64(c("n_name").cast("binary")))
# SHA3-256 of the regions' names.
_SHA3 = {
    "AFRICA": "F8D4C0F33AA6751E95BD1BAB9F80816647F44DADA21DC94E38F97704DB611F8E", "AMERICA": "C1842D3BFBB77B6613009F4B999DECC2D2D794EA466D9EE9697F841AFD732618",
    "ASIA": "FF13E5C59E26AF31811234D39850180502C68CAE21452CA7C254D93067831E80", "EUROPE": "CEC5358E37774A93373B4F087ED0087AB3567CE3F2636EB61C962BA739CE3A2C",
    "MIDDLE EAST": "B7AEE87D6C34474097F56294F9B1ED618D880EBA7BC8CB2006DB68A11F5865DC",
}
_select("sha3", "region", "r_regionkey", "CASE r_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SHA3.items()) + " END AS h", h=lambda: F.hex(X.sha3(c("r_name"))))
_select("round_trips", "nation", "n_nationkey", "n_name AS b85, n_name AS zip, CAST(n_nationkey AS DOUBLE) / 3 AS ieee, n_name AS rot",
        b85=lambda: X.unbase85(X.base85(c("n_name"))).cast("string"), zip=lambda: X.uncompress(X.compress(c("n_name"))).cast("string"), ieee=lambda: X.ieee754_from_blob(X.ieee754_to_blob(c("n_nationkey").cast("double") / 3)), rot=lambda: S.rot13(S.rot13(c("n_name"))))
_select("ieee754_parts", "nation", "n_nationkey", "CAST(n_nationkey AS DOUBLE) * 0.5 AS back", back=lambda: X.ieee754_compose(X.ieee754_mantissa(c("n_nationkey") * 0.5), X.ieee754_exponent(c("n_nationkey") * 0.5)))
_select("format_text", "nation", "n_nationkey", "printf('%05d|%-12s|%s', n_nationkey, n_name, format('{:.2f}', n_regionkey / 3.0)) AS a, '''' || n_name || '''' AS q", a=lambda: X.format_text("%05d|%-12s|%.2f", c("n_nationkey"), c("n_name"), c("n_regionkey") / 3.0), q=lambda: X.format_text("%Q", c("n_name")))
_select("zorder", "nation", "n_nationkey", "n_nationkey AS x, n_regionkey AS y", x=lambda: S.unzorder(S.zorder(c("n_nationkey"), c("n_regionkey")), 2, 0).cast("int"), y=lambda: S.unzorder(S.zorder(c("n_nationkey"), c("n_regionkey")), 2, 1).cast("int"))
_select("edit_distance", "nation", "n_nationkey", "CAST(levenshtein(n_name, 'NATION_1') AS BIGINT) AS unit, CAST(levenshtein(n_name, 'NATION_1') AS BIGINT) AS weighted", unit=lambda: F.levenshtein(c("n_name"), F.lit("NATION_1")).cast("bigint"), weighted=lambda: X.weighted_distance(c("n_name"), F.lit("NATION_1"), 1, 1, 1))
_select("prefix_functions", "nation", "n_nationkey", "CAST(CASE WHEN n_name LIKE 'NATION_1%' AND starts_with(n_name, 'NATION_1') THEN 8 WHEN starts_with(n_name, 'NATION_') THEN 7 ELSE 0 END AS BIGINT) AS n, CAST(length(n_name) + 1 AS BIGINT) AS k", n=lambda: S.prefix_length(c("n_name"), F.lit("NATION_1")).cast("bigint"), k=lambda: F.size(S.prefixes(c("n_name"))).cast("bigint"))
_select("decimal_functions", "orders", "o_orderkey", "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 3 AS DOUBLE) AS m, CAST(CAST(o_totalprice AS DECIMAL(18,2)) - 0.01 AS DOUBLE) AS s", m=lambda: (c("o_totalprice").cast("decimal(18,2)") * F.lit(3)).cast("double"), s=lambda: (c("o_totalprice").cast("decimal(18,2)") - F.lit("0.01").cast("decimal(3,2)")).cast("double"))
_select("totype", "part", "p_partkey", "TRY_CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS i, TRY_CAST(p_brand AS BIGINT) AS none, TRY_CAST(CAST(p_size AS VARCHAR) AS DOUBLE) AS r", i=lambda: F.nullif(F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit("")).try_cast("bigint"), none=lambda: c("p_brand").try_cast("bigint"), r=lambda: c("p_size").cast("string").try_cast("double"))
_select("geopoly", "nation", "n_nationkey", "CAST(n_nationkey + 1 AS DOUBLE) * 2 AS area, 2 AS inside, 0 AS outside",
        area=lambda: X.geopoly_area(_box()), inside=lambda: X.geopoly_contains_point(_box(), F.lit(0.5), F.lit(0.5)), outside=lambda: X.geopoly_contains_point(_box(), F.lit(-1.0), F.lit(0.5)))
_select("unistr", "region", "r_regionkey", "'caf' || chr(233) || r_name AS u", u=lambda: X.unistr(F.concat(F.lit("caf\\u00e9"), c("r_name"))))


def _box():
    w = (c("n_nationkey") + 1).cast("string")
    return F.concat(F.lit("[[0,0],["), w, F.lit(",0],["), w, F.lit(",2],[0,2],[0,0]]"))


@query("natural_number_collation", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS r FROM nation")
def natural_number_collation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that order by the numbers in them."""
    from pyspark.sql.window import Window

    name = F.concat(F.lit("item "), c("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(S.number_key(name))).cast("bigint").alias("r"))


@query("random_values")
def random_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random whole numbers and identifiers: only their number can be checked."""
    return table(spark, sf_dir, "region").select("r_regionkey", ((F.rand() - 0.5) * 2.0**63).cast("bigint").alias("r"), F.uuid().alias("u"))
