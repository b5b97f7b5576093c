"""Golden values of functions that the tables don't exercise."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.functions import dates as D
from quillon.functions import extras as X
from quillon.functions import json_text as J
from quillon.functions import scalar as S
from quillon.operators import bands as B
from quillon.operators import changes as C
from quillon.operators import match as M
from quillon.operators import search as Q
from quillon.plans import registry
from quillon.sources import tables as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("start", "length", "want"),
    [(0, 2, "a"), (-1, 1, "g"), (5, -1, "d"), (-5, -2, "ab"), (1, 3, "abc"), (-3, None, "efg"), (9, 2, ""), (0, None, "abcdefg"), (2, -1, "a"), (3, -5, "ab"), (-9, 4, "ab")],
)
def test_substr(spark, start, length, want):
    assert one(spark, S.substr(F.lit("abcdefg"), start, length)) == want


def test_text(spark):
    assert one(spark, S.quote(F.lit("it's"))) == "'it''s'"
    assert one(spark, S.unhex(F.lit("41-42"), "-")) == bytearray(b"AB")
    assert one(spark, S.unhex(F.lit("4x"))) is None
    assert one(spark, S.unicode(F.lit(""))) is None
    assert one(spark, S.concat(F.lit(None), F.lit("a"))) == "a"
    assert one(spark, S.like(F.lit("ABC\nd"), "a%D")) is True
    assert one(spark, S.glob(F.lit("a]b"), "a[]]b")) is True
    assert one(spark, X.unistr(F.lit("\\0041\\+01F600\\\\"))) == "A\U0001f600\\"
    assert one(spark, X.format_text("%+05d|%-4s|%x|%,d|%%|%.1f", F.lit(7), F.lit("ab"), F.lit(255), F.lit(1234567), F.lit(2.25))) == "+0007|ab  |ff|1,234,567|%|2.2"


def test_numbers(spark):
    assert one(spark, S.divide(F.lit(-7), F.lit(2))) == -3
    assert one(spark, S.divide(F.lit(1), F.lit(0))) is None
    assert one(spark, S.shift_left(F.lit(-1).cast("bigint"), F.lit(-70))) == -1
    assert one(spark, S.shift_right(F.lit(8).cast("bigint"), F.lit(-1))) == 16
    assert one(spark, S.to_integer(F.lit("12abc"))) == 12
    assert one(spark, S.to_real(F.lit("-.5e1x"))) == -5.0
    assert one(spark, S.log(F.lit(-1.0))) is None
    assert one(spark, S.acos(F.lit(2.0))) is None


def test_dates(spark):
    t = F.lit("2024-01-31 23:59:59").cast("timestamp_ntz")
    assert one(spark, D.date(D.modified(t, "+1 month"))) == "2024-03-02"
    assert one(spark, D.date(D.modified(t, "+1 month", "floor"))) == "2024-02-29"
    assert one(spark, D.datetime(D.modified(t, "+00:00:01"))) == "2024-02-01 00:00:00"
    assert one(spark, D.date(D.modified(t, "weekday 3"))) == "2024-01-31"
    assert one(spark, D.date(D.modified(t, "+0001-01-01"))) == "2025-03-04"
    assert one(spark, D.julianday(F.lit("2000-01-01 12:00:00").cast("timestamp_ntz"))) == 2451545.0
    assert one(spark, D.timediff(F.lit("2023-02-15").cast("timestamp_ntz"), F.lit("2023-03-15").cast("timestamp_ntz"))) == "-0000-01-00 00:00:00.000"
    assert one(spark, D.unixepoch(F.lit("1969-12-31 23:59:59").cast("timestamp_ntz"))) == -1


def spanned(a, b):
    """The reference's loop, over datetimes: b moves by whole months into the month of a, then back until it does not pass a."""
    month = lambda t: t.year * 12 + t.month - 1
    moved = lambda m: datetime(m // 12, m % 12 + 1, 1) + (b - datetime(b.year, b.month, 1))
    side, m, steps = 1 if a >= b else -1, month(a), abs(month(a) - month(b))
    while side * (a - moved(m)) < timedelta(0):
        m, steps = m - side, steps - 1
    rest = abs(a - moved(m))
    clock = str(datetime(2000, 1, 1) + timedelta(seconds=rest.seconds, microseconds=rest.microseconds) + timedelta(microseconds=1))[11:]
    return f"{'+' if side > 0 else '-'}{steps // 12:04}-{steps % 12:02}-{rest.days:02} {clock[:12]}"


def test_timediff(spark):
    days = ["1999-01-31", "1999-12-31", "2000-01-29", "2000-01-31", "2000-02-28", "2000-02-29", "2000-03-01", "2000-03-02", "2000-03-31", "2001-01-31", "2001-03-01", "2023-02-15", "1969-07-20", "1066-10-14"]
    times = [datetime.fromisoformat(d) + timedelta(hours=h, milliseconds=ms) for d in days for h, ms in ((0, 0), (23, 3_599_999), (12, 34_567))]
    pairs = [(a, b) for a in times for b in times] + [(None, times[0]), (times[0], None)]
    found = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz").select("a", "b", D.timediff(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r for r in found if r.d != (r.a and r.b and spanned(r.a, r.b))] == []
    known = {("2000-03-02", "2000-01-31"): "+0000-01-00", ("2000-01-31", "2000-03-02"): "-0000-01-02", ("1999-01-31", "2000-03-02"): "-0001-01-02", ("2001-03-01", "2001-01-31"): "+0000-00-29"}
    for (a, b), want in known.items():
        assert one(spark, D.timediff(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))) == want + " 00:00:00.000"


def test_time_values_stay_small_when_nested(spark):
    t = F.col("id").cast("timestamp").cast("timestamp_ntz")
    nested = D.timediff(D.modified(t, *["+1 day", "-02:03", "+5 seconds"] * 3), D.modified(t, "start of month", "+90 minutes"))
    plan = spark.range(3).select(nested.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 200_000
    assert len(spark.range(3).select(D.unixepoch(D.modified(t, *["+1 day"] * 6)).alias("x"))._jdf.queryExecution().analyzed().toString()) < 5_000


def test_time_values_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        t = F.lit("2024-03-10 01:59:59.999999").cast("timestamp_ntz")  # clocks there jump from 2 to 3
        assert one(spark, D._micros(D.modified(t, "+30 minutes"))) == 1_710_037_799_999_999
        assert one(spark, D.from_micros(F.lit(1_710_037_799_999_999)).cast("string")) == "2024-03-10 02:29:59.999999"
        assert one(spark, D.timediff(D.modified(t, "+2 hours"), t)) == "+0000-00-00 02:00:00.000"
        assert one(spark, D._micros(F.lit("0001-01-01 00:00:00.000001").cast("timestamp_ntz"))) == -62_135_596_799_999_999
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_json(spark):
    assert one(spark, J.json_extract(F.lit('{"a":[1,2,{"b":"x"}]}'), F.lit("$.a[#-1].b"))) == "x"
    assert one(spark, J.json_extract(F.lit('{"a":1,"b":true}'), F.lit("$.a"), F.lit("$.c"))) == "[1,null]"
    assert one(spark, J.json_set(F.lit('{"a":1}'), F.lit("$.b.c"), F.lit("z"))) == '{"a":1,"b":{"c":"z"}}'
    assert one(spark, J.json_array_insert(F.lit("[1,3]"), F.lit("$[1]"), F.lit(2))) == "[1,2,3]"
    assert one(spark, J.json_remove(F.lit("[0,1,2]"), F.lit("$[0]"), F.lit("$[0]"))) == "[2]"
    assert one(spark, J.json_patch(F.lit('{"a":1,"b":2}'), F.lit('{"a":null,"c":3}'))) == '{"b":2,"c":3}'
    assert one(spark, J.json_arrow(F.lit('["a"]'), F.lit("0"))) == '"a"'
    assert one(spark, J.json_pretty(F.lit('{"a":[]}'))) == '{\n    "a": []\n}'
    assert one(spark, J.json_minified(F.lit("{a:'b',/*c*/d:[1,],e:0x1F,}"))) == '{"a":"b","d":[1],"e":31}'
    assert one(spark, J.json_type(F.lit('{"a":1.5}'), F.lit("$.a"))) == "real"


def test_band_pairs(spark):
    rows = [(z, k) for z in (-3, -2, -1, 0, 1, 4, None) for k in (-(2**63), -(2**44) - 1, -1, 0, 1, 5, 5, 2**22 - 1, 2**22, 2**44 + 7, 2**63 - 1, None)] + [(1, 5)] * 3
    for width in (0, 1, 2):
        pairs = [a[1] for a in rows for b in rows if None not in a + b and abs(a[0] - b[0]) <= width and a[1] < b[1]]
        small = [a[1] for a in rows for b in rows if None not in a + b and abs(a[0] - b[0]) <= width and a[1] < b[1] and abs(a[1]) < 2**50]
        df = spark.createDataFrame(rows, "z int, k long")
        assert B.band_pairs(df, "z", "k", width).select("n").first()[0] == len(pairs)
        assert B.band_pairs(df.filter((F.abs(F.col("k").cast("decimal(20,0)")) < 2**50) | (F.col("k") == 2**63 - 1)), "z", "k", width).first()[1] == sum(small)
    assert tuple(B.band_pairs(df.limit(0), "z", "k").first()) == (0, None)
    assert tuple(B.band_pairs(df.filter("k = 5"), "z", "k").first()) == (0, None)


def test_band_pairs_are_not_built(spark):
    n = 300_000
    many = spark.range(n).select(F.lit(7).alias("z"), F.col("id").alias("k"))
    assert tuple(B.band_pairs(many, "z", "k").first()) == (n * (n - 1) // 2, sum(k * (n - 1 - k) for k in range(n)))
    plan = registry.queries()["join_theta_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_polygons(spark):
    box = F.lit("[[0,0],[4,0],[4,2],[0,2],[0,0]]")
    assert one(spark, X.geopoly_area(box)) == 8.0
    assert one(spark, X.geopoly_contains_point(box, F.lit(4.0), F.lit(1.0))) == 1
    assert one(spark, X.geopoly_area(F.lit("[[0,0]]"))) is None


def test_sources(spark, tmp_path):
    assert [r[0] for r in T.generate_series(spark, 0, -1).collect()] == []
    assert T.generate_series(spark, 0, 100, 5).count() == 21
    (tmp_path / "a.csv").write_text('1,"x\ny"\n2,z\n')
    got = T.csv_rows(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["c1", "c2"] and sorted(map(tuple, got.collect())) == [("1", "x\ny"), ("2", "z")]
    import zipfile

    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("m.txt", "hello")
    found = T.zip_members(spark, str(tmp_path / "*.zip")).collect()
    assert [(r["name"], r["sz"], bytes(r["data"])) for r in found] == [("m.txt", 5, b"hello")]
    assert T.folder(spark, str(tmp_path)).count() == 2


def test_changes_keep_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "k int, v int")
    stay, gone = C.delete(df, F.col("v") > 3)
    assert [tuple(r) for r in stay.collect()] == [(1, None)] and [tuple(r) for r in gone.collect()] == [(2, 5)]


def test_phrase_with_repeated_words(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, "a a b c"), (3, None)], "id int, text string")
    assert [r[0] for r in Q.phrase(Q.tokens(df, "id", "text"), "id", ["a", "b", "a"]).collect()] == [1]


def test_streaming(spark, tmp_path):
    from quillon.streaming import windows as E

    spark.sql("SELECT TIMESTAMP '2024-01-01 00:10:00' AS ts, 1L AS user_id, 'x' AS event_type, 2.0D AS value UNION ALL SELECT TIMESTAMP '2024-01-01 00:50:00', 1L, 'x', 3.0D").write.parquet(str(tmp_path / "in"))
    schema = "ts timestamp, user_id long, event_type string, value double"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = E.tumbling(stream, "1 hour", late="1 minute").writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["total"]) for r in spark.table("tumbled").collect()] == [(2, 5.0)]
    q = E.running_totals(stream).writeStream.outputMode("update").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("totals").collect()] == [(1, 2, 5.0)]


def test_queries_written_as_text(spark):
    shape = "id int, title string, body string"
    df = spark.createDataFrame([(1, "One two", "a b c x x x a"), (2, None, "c b"), (3, "", ""), (4, "b", None), (5, "say 'a b'", "A-b, d")], shape)

    def ids(text):
        return [r[0] for r in df.filter(M.matches({"title": F.col("title"), "body": F.col("body")}, text)).orderBy("id").collect()]

    assert ids("a") == ids('"A"') == [1, 5] and ids("b") == [1, 2, 4, 5]
    assert ids("a b NOT c") == [5] and ids("a OR b NOT c") == [1, 4, 5] and ids("(a OR b) NOT c") == [4, 5]
    assert ids('"a b" d') == ids("a + b AND d") == [5] and ids("tw*") == [1] and ids("^b") == [4] and ids("^ one + two") == [1]
    assert ids("title : b") == [4, 5] and ids("-title : b") == ids("{body} : b") == [1, 2, 5] and ids("{title body} : c") == [1, 2]
    assert ids("NEAR(a c, 1)") == [1] and ids("NEAR(a c, 0)") == [] and ids("NEAR(c a, 2)") == [1] and ids('NEAR("a b" x, 1)') == [1] and ids('NEAR("a b" x, 0)') == []
    assert ids('""') == []
    for wrong in ("", "a OR", "(a", "a )", "none : a", "NEAR(a, b)", "a + ", "AND", "a & b"):
        with pytest.raises(M.QueryError):
            ids(wrong)


def test_time_zones_and_now(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        t = spark.range(1).select(D.parse(F.lit("2024-07-01 12:00")).alias("t"), D.now().alias("now"))
        got = t.select(D.datetime(D.modified(F.col("t"), "utc")), D.datetime(D.modified(F.col("t"), "localtime")), D.datetime(D.modified(F.col("t"), "utc", "localtime")), F.col("now")).first()
        assert list(got)[:3] == ["2024-07-01 16:00:00", "2024-07-01 08:00:00", "2024-07-01 12:00:00"]
        import datetime

        assert abs(got[3] - datetime.datetime.now(datetime.UTC).replace(tzinfo=None)) < datetime.timedelta(minutes=2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
