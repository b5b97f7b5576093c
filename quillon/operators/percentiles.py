"""Exact discrete percentiles of large groups, without a list of a group's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def percentile_disc_by(df: DataFrame, keys: Sequence[str], value: str, fraction: float, name: str = "percentile_disc") -> DataFrame:
    """For each group the value at rank floor(fraction * (n - 1)), from 0, in order; null without values.

    Equal values are counted before the shuffle; the window reads counts of distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("_to", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    rank = F.floor(F.lit(fraction) * (F.col("_all") - 1))
    found = ranked.filter((F.col("_to") > rank) & (F.col("_to") - F.col("_n") <= rank)).select(*keys, F.col(value).alias(name))
    return df.select(*keys).distinct().join(found, list(keys), "left")
