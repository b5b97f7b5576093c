"""Aggregates whose semantics differ from Spark's, as expressions over built-in ones.

The discrete percentile is in percentiles.py.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """Sum as a real number; 0.0 without values."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def group_concat(x: Column, separator: str = ",", *order: Column) -> Column:
    """Texts in the given order; null without values."""
    return F.when(F.count(x) > 0, F.array_join(_ordered(x, order), separator))


def _ordered(x: Column, order: tuple[Column, ...]) -> Column:
    rows = F.filter(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], x.cast("string").alias("x"))), lambda r: r["x"].isNotNull())
    return F.transform(F.array_sort(rows), lambda r: r["x"])


def percentile(x: Column, percent: float) -> Column:
    """Interpolated percentile, percent from 0 to 100."""
    return F.percentile(x.cast("double"), percent / 100)


def percentile_cont(x: Column, fraction: float) -> Column:
    return F.percentile(x.cast("double"), fraction)


def filtered(aggregate, x: Column, condition: Column) -> Column:
    """aggregate(x) FILTER (WHERE condition)."""
    return aggregate(F.when(condition, x))


def at_extreme(value: Column, by: Column, largest: bool = True) -> Column:
    """A bare column next to max() or min(): its value in the row that holds the extreme."""
    return F.max_by(value, by) if largest else F.min_by(value, by)


def decimal_sum(x: Column, scale: int = 10) -> Column:
    """Exact sum of decimal texts."""
    return F.sum(x.try_cast(f"decimal(28,{scale})"))


def bounding_box(x: Column, y: Column) -> Column:
    return F.struct(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))
