"""Sharding by jump consistent hashing, in SQL expressions only.

A key's 64-bit value seeds the generator key * 2862933555777941757 + 1 (modulo 2^64); the jumps it
yields end at the key's shard. No ring table exists, and a shard that is appended takes rows only
into itself: about 1 / (n + 1) of every other.

Defined results: a null key hashes as 0; integer keys stand for themselves, other types for their
XXH64; a null or empty text has no bytes and the CRC-32 of none, 0, a long one counts whole. Repeated rows
get slots of their own, and rows that tie in key and text may take each other's. An empty table gives no
rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The generator's multiplier in two halves of 32 bits, as published with the method.
HIGH, LOW = 0x27BB2EE6, 0x87B0B0FD
M32, M16 = 0xFFFFFFFF, 0xFFFF
#: Bytes that every row costs besides its text.
ROW_BYTES = 8
#: Runs into which each shard is cut to number its rows. A run is what one sort holds.
RUNS = 1024


def key_bits(df: DataFrame, key: str) -> Column:
    """The 64 bits that stand for a key."""
    kind = df.schema[key].dataType
    bits = F.col(key).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(key)
    return F.coalesce(bits, F.lit(0).cast("long"))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state. Each product of halves fits into 63 bits, so ANSI mode never overflows."""

    def part(c: Column, bits: int, mask: int) -> Column:
        return F.shiftrightunsigned(c, bits).bitwiseAND(_long(mask))

    p = low.bitwiseAND(_long(M16)) * _long(LOW)
    q = part(low, 16, M16) * _long(LOW)
    t = p.bitwiseAND(_long(M32)) + F.shiftleft(q.bitwiseAND(_long(M16)), 16) + _long(1)
    across = (low * _long(HIGH)).bitwiseAND(_long(M32))
    upper = high.bitwiseAND(_long(M16)) * _long(LOW) + F.shiftleft((part(high, 16, M16) * _long(LOW)).bitwiseAND(_long(M16)), 16)
    top = F.shiftrightunsigned(p, 32) + F.shiftrightunsigned(q, 16) + F.shiftrightunsigned(t, 32) + across + upper.bitwiseAND(_long(M32))
    return top.bitwiseAND(_long(M32)), t.bitwiseAND(_long(M32))


def jump_shard(bits: Column, shards: int) -> Column:
    """The shard, from 0 to shards - 1, of a key's 64 bits."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def state(at: Column, to: Column, high: Column, low: Column) -> Column:
        return F.struct(at.alias("at"), to.alias("to"), high.alias("high"), low.alias("low"))

    def jump(s: Column, _: Column) -> Column:
        # One level of lambda binds the new generator state, so that it is computed once.
        high, low = _step(s["high"], s["low"])
        new = F.transform(F.array(F.struct(high.alias("high"), low.alias("low"))), lambda g: state(s["to"], F.floor((s["to"] + _long(1)).cast("double") * (F.lit(2.0**31) / (F.shiftrightunsigned(g["high"], 1) + _long(1)).cast("double"))), g["high"], g["low"]))
        return F.when(s["to"] < _long(shards), new[0]).otherwise(s)

    start = state(_long(-1), _long(0), F.shiftrightunsigned(bits, 32), bits.bitwiseAND(_long(M32)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda s: s["at"].cast("int"))


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, runs: int = RUNS) -> DataFrame:
    """Each row's key, size, text_crc32, shard, slot and the shard it has with one more shard.

    Slots number a shard's rows from 0 without a gap. A shard is cut into runs by a hash; a run's
    first slot is the number of rows in the runs before it (a table of shards * runs rows, whatever the
    input), so that no task sorts more than a run.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bits = key_bits(df, key)
    rows = df.select(
        F.col(key).alias("_key"),
        (F.octet_length(body).cast("long") + _long(ROW_BYTES)).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        jump_shard(bits, shards).alias("shard"),
        jump_shard(bits, shards + 1).alias("grown_shard"),
        # The text too, since many rows may share a key.
        F.pmod(F.xxhash64(bits, body), _long(runs)).cast("int").alias("_run"),
    )
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("shard", "_run").count().select("shard", "_run", F.coalesce(F.sum("count").over(before), _long(0)).alias("_first"))
    within = Window.partitionBy("shard", "_run").orderBy("_key", "text_crc32", "size")
    return (
        rows.withColumn("_place", F.row_number().over(within))
        .join(F.broadcast(firsts), ["shard", "_run"])  # at most shards * runs rows
        .select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_place") - _long(1)).alias("slot"), "grown_shard")
    )
