"""Window frames that Spark has no syntax for: GROUPS, EXCLUDE and FILTER.

GROUPS numbers the peer groups with dense_rank and ranges over that number. EXCLUDE subtracts what it
leaves out, so that sum, count and avg stay linear; min and max read the frame's list. All windows of
one call share a partitioning and an order, so Spark shuffles and sorts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

FIRST, LAST, HERE = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


def base(partition: Sequence[str | Column], order: Sequence[Column]) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order)


def groups_frame(df: DataFrame, partition: Sequence[str | Column], order: Sequence[Column], start: int, end: int, name: str = "_group") -> tuple[DataFrame, WindowSpec]:
    """df with the peer group's number, and the window of the groups from start to end around a row's."""
    return df.withColumn(name, F.dense_rank().over(base(partition, order))), Window.partitionBy(*partition).orderBy(name).rangeBetween(start, end)


def filtered(aggregate, x: Column, condition: Column, window: WindowSpec) -> Column:
    """aggregate(x) FILTER (WHERE condition) OVER window, for aggregates that skip nulls."""
    return aggregate(F.when(condition, x)).over(window)


def exclude(x: Column, partition: Sequence[str | Column], order: Sequence[Column], start: int, end: int, what: str = "current row", rows: bool = True) -> dict[str, Column]:
    """sum, count and avg of x over ROWS (or RANGE) frames that hold the current row, without the current
    row, its peer group, or its ties. A frame without values has sum and avg null.

    With a frame of rows that cuts through a peer group, only the part of the group in the frame is taken
    out."""
    w = base(partition, order)
    frame = w.rowsBetween(start, end) if rows else w.rangeBetween(start, end)
    total, n = F.coalesce(F.sum(x).over(frame), F.lit(0)), F.count(x).over(frame)
    own_sum, own_n = F.coalesce(x, F.lit(0)), F.when(x.isNull(), 0).otherwise(1)
    if what == "current row":
        out_sum, out_n = own_sum, own_n
    else:
        if rows and (start, end) != (FIRST, LAST):
            raise ValueError("peers of a frame of rows can be left out only where the frame is the partition")
        peers = w.rangeBetween(0, 0) if len(order) == 1 else w.rangeBetween(HERE, HERE)
        out_sum, out_n = F.coalesce(F.sum(x).over(peers), F.lit(0)), F.count(x).over(peers)
        if what == "ties":
            out_sum, out_n = out_sum - own_sum, out_n - own_n
        elif what != "group":
            raise ValueError(f"cannot exclude {what!r}")
    left = n - out_n
    return {"sum": F.when(left > 0, total - out_sum), "count": left, "avg": F.when(left > 0, (total - out_sum) / left)}


def extreme_without_current(x: Column, partition: Sequence[str | Column], order: Sequence[Column], start: int, end: int, largest: bool = True) -> Column:
    """max or min over the rows of a frame other than the current one: the frame's two parts."""
    w = base(partition, order)
    f = F.max if largest else F.min
    before = f(x).over(w.rowsBetween(start, -1)) if start < 0 else F.lit(None)
    after = f(x).over(w.rowsBetween(1, end)) if end > 0 else F.lit(None)
    return F.greatest(before, after) if largest else F.least(before, after)


def exclude_anywhere(df: DataFrame, x: str, partition: Sequence[str], order: Sequence[str], start: int, end: int, what: str, kind: str = "rows") -> DataFrame:
    """df with sum, count and avg of x over a frame of rows or of peer groups, wherever it lies, without the
    current row, its peers ("group") or its other peers ("ties"). Among peers any order is a right one;
    one is chosen and held for all frames."""
    if what not in ("current row", "group", "ties") or kind not in ("rows", "groups"):
        raise ValueError(f"cannot exclude {what!r} of {kind!r}")
    spec = Window.partitionBy(*partition).orderBy(*order)
    df = df.withColumn("_row", F.row_number().over(spec)).withColumn("_group", F.dense_rank().over(spec))
    v, here = F.col(x), start <= 0 <= end
    by_row, own = Window.partitionBy(*partition).orderBy("_row"), Window.partitionBy(*partition, "_group").orderBy("_row")
    # Peers stand side by side, so that a frame of rows, cut to the peer group, is a frame of the group's rows.
    frame = by_row.rowsBetween(start, end) if kind == "rows" else Window.partitionBy(*partition).orderBy("_group").rangeBetween(start, end)
    peers = own.rowsBetween(start, end) if kind == "rows" else own.rowsBetween(FIRST, LAST)
    total, n = F.coalesce(F.sum(v).over(frame), F.lit(0)), F.count(v).over(frame)
    own_sum, own_n = (F.coalesce(v, F.lit(0)), F.when(v.isNull(), 0).otherwise(1)) if here else (F.lit(0), F.lit(0))
    if what == "current row":
        out_sum, out_n = own_sum, own_n
    elif kind == "groups" and not here:
        out_sum, out_n = F.lit(0), F.lit(0)
    else:
        out_sum, out_n = F.coalesce(F.sum(v).over(peers), F.lit(0)), F.count(v).over(peers)
        if what == "ties":
            out_sum, out_n = out_sum - own_sum, out_n - own_n
    found = df.withColumn("count", n - out_n).withColumn("_left", total - out_sum)
    left = F.when(F.col("count") > 0, F.col("_left"))
    return found.withColumn("sum", left).withColumn("avg", left / F.col("count")).drop("_row", "_group", "_left")
