"""Sums over the pairs of a band join, without the pairs, whose number grows with the square of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of a key that one window orders: it holds at most 2 ** BITS rows, however many have the same band.
BITS = 22


def band_pairs(df: DataFrame, band: str, key: str, width: int = 1) -> DataFrame:
    """Over all pairs of rows a and b with band (whole numbers) at most width apart and key (64-bit) of a
    below that of b: their number n and the sum s of a's keys, null without pairs. Rows with a null make none.

    Each row joins, as b, all bands that it is near to. Two keys first differ in one group of BITS bits, and
    there they are counted: sums by key are added up over the larger keys with the same higher bits, then
    merged into one row for these bits, and so on up."""
    rows = df.select(F.col(band).cast("long").alias("_own"), F.col(key).cast("long").alias("_k")).dropna()
    near = rows.select(F.explode(F.sequence(F.col("_own") - width, F.col("_own") + width)).alias("_band"), "_own", "_k")
    wide = lambda c: c.cast("decimal(38,0)")
    a, b = F.count_if(F.col("_band") == F.col("_own")), F.count(F.lit(1))
    sums = near.groupBy("_band", "_k").agg(a.alias("_a"), b.alias("_b"), wide(wide(a) * F.col("_k")).alias("_keys"), F.lit(0).cast("long").alias("_n"), wide(F.lit(0)).alias("_s"))
    above = F.coalesce(F.sum("_b").over(Window.partitionBy("_band", "_higher").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for shift in range(BITS, 64 + BITS, BITS):
        higher = F.shiftright("_k", BITS) if shift < 64 else F.lit(0).cast("long")
        met = sums.select("*", higher.alias("_higher")).select("*", above.alias("_above"))
        n, s = F.sum(F.col("_n") + F.col("_a") * F.col("_above")), F.sum(wide(F.col("_s") + F.col("_keys") * F.col("_above")))
        sums = met.groupBy("_band", F.col("_higher").alias("_k")).agg(*[F.sum(c).alias(c) for c in ("_a", "_b", "_keys")], n.alias("_n"), s.alias("_s"))
    total = sums.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.sum("_s").alias("s"))
    return total.select("n", F.when(F.col("n") > 0, F.col("s")).cast("long").alias("s"))
