"""Changes to tables, with null keys and new rows that repeat a key."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import scalar
from quillon.operators import changes

SHAPE = "k int, v string, n int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_conflicts(spark):
    old = spark.createDataFrame([(1, "a", 0), (None, "keep", 0), (2, "b", 0)], SHAPE)
    new = spark.createDataFrame([(5, "first", 1), (5, "last", 2), (2, "c", 3), (None, "x", 4), (None, "x", 5)], SHAPE)
    common = [(1, "a", 0), (None, "keep", 0), (None, "x", 4), (None, "x", 5)]
    assert rows(changes.insert_or_ignore(old, new, ["k"], F.col("n"))) == sorted([*common, (2, "b", 0), (5, "first", 1)], key=str)
    assert rows(changes.insert_or_replace(old, new, ["k"], F.col("n"))) == sorted([*common, (2, "c", 3), (5, "last", 2)], key=str)
    got = changes.upsert(old, new, ["k"], {"v": lambda a, b: F.concat(a, b)}, order=F.col("n"), repeats=True)
    assert rows(got) == sorted([*common, (2, "bc", 0), (5, "firstlast", 1)], key=str)
    with pytest.raises(ValueError):
        changes.insert_or_abort(old, new, ["k"])
    assert changes.insert_or_abort(old, new.filter("k is null"), ["k"]).count() == 5
    assert rows(changes.delete_first(old, F.lit(True), [F.col("k").asc_nulls_first()], 1, ["k"])) == [(1, "a", 0), (2, "b", 0)]


def test_division_at_the_limits(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([(top, 3), (-top, 2), (-top - 1, -1), (-top, -1), (7, 0), (None, 1)], "a long, b long")
    assert [r[0] for r in df.select(scalar.divide(F.col("a"), F.col("b"))).collect()] == [top // 3, -(top // 2), None, top, None, None]
    text = spark.createDataFrame([("99999999999999999999x",), (" -99999999999999999999",), ("12abc",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in text.select(scalar.to_integer(F.col("t"))).collect()] == [top, -top - 1, 12, 0, 0, None]
