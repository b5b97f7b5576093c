import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import balance, shards


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 24, 1000])
def test_jump_hash(spark, n):
    keys = [0, 1, -1, 7, 10**15, 2**63 - 1, -(2**63), *range(100, 160)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", shards.jump_shard(F.col("k"), n).alias("s"))
    assert all(r["s"] == jump(r["k"], n) for r in df.collect())


def test_shards(spark):
    rows = [(i, "ß" * (i % 5), i % 3) for i in range(500)] + [(7, "x", 0), (7, "x", 0), (None, None, 1), (None, "y", 1)]
    got = shards.assign(spark.createDataFrame(rows, "doc_id long, text string, shard int")).collect()
    assert len(got) == len(rows)
    for s in range(24):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got)
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 3} == {(14, zlib.crc32("ßßß".encode()))}
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] is None} == {(8, 0), (9, zlib.crc32(b"y"))}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shards.assign(empty).count() == 0


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """The contract read literally: deal, stop the full, deal their excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, got = share * sum(sizes.values()), dict.fromkeys(names, 0.0)
    left, open_ = total, set(names)
    while left > 1e-9 and open_:
        weight = sum(w[s] for s in open_)
        dealt = {s: left * w[s] / weight for s in open_}
        left = 0.0
        for s, x in dealt.items():
            got[s] += x
            if got[s] >= cap * sizes[s]:
                left += got[s] - cap * sizes[s]
                got[s] = cap * sizes[s]
                open_.discard(s)
    return got


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), ["b", "a", "é", None, "Z", "hot"][i % 6 if i % 2 else 5]) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", None), (1002, "  \t\n ", "zero"), (5, rows[5][1], rows[5][2]), (1003, "w " * 5000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lam", F.lit("clash"))
    got = balance.mix(df).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets(sizes)
    source = {i: s for i, _, s in rows}
    assert len(got) == len(rows)
    for s, size in sizes.items():
        own = [r for r in got if source[r["doc_id"]] == s]
        assert all(r["source_size"] == size and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 2
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, balance.mix(df.repartition(7)).collect()))
    copies = balance.mixed_copies(df)
    assert copies.columns == df.columns
    assert balance.mix(df.limit(0)).count() == 0
