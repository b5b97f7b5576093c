"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) turns a unit vector; its
hash is the signed axis nearest to it. Each of a few tables hashes every vector by two such axes, so that
a table has 4 size^2 buckets (the second axis is one of fewer coordinates where these would be over
BUCKETS). A query probes a table's buckets in the order of the sum of its components along their axes
(multiprobe) until those probed hold WIDTH * n ** GROWTH of the n vectors, so that the share of the
vectors that a query meets shrinks as their number grows. Every vector found is scored exactly in double
precision. Neighbouring buckets are packed into groups of about SLICE vectors and larger ones cut into
slices; a group's vectors are held by one task at a time and its queries stream past them, so that
neither a bucket with a third of all vectors nor one that all queries probe is held whole.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do rows with a null id; shorter vectors count as filled up with zeros; equal scores go to the smaller
id. A query meets every row but its own, so repeated rows are neighbours of each other and, as queries,
are answered once each. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize

#: Tables; vectors that a query's probes in a table hold at least: WIDTH * n ** GROWTH, and more than k.
TABLES, WIDTH, GROWTH = 12, 0.22, 0.75
#: The most buckets of a table; vectors of a group or slice; vectors of the sample that bounds the k-th
#: score of a query from below (among those of its own probes).
BUCKETS, SLICE, SAMPLE = 1 << 14, 4096, 1 << 14
#: Queries that are hashed or answered at a time; components of the vectors that are scored at a time.
BLOCK, ROOM = 128, 1 << 21
SEED = 20_240_607


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    v = vector.cast("array<double>")
    return F.coalesce(F.forall(v, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False))), F.lit(False))


def valid(vector: Column) -> Column:
    """Whether a vector can take part in a search by direction."""
    return finite(vector) & F.coalesce(F.exists(vector.cast("array<double>"), lambda x: x != 0), F.lit(False))


def vector_rows(df: DataFrame, fits: Column, is_query: Column, id: str, vector: str) -> DataFrame:
    """row (a number of its own), id, v and q of the rows that fit, written. Single precision is kept as it
    is, since it takes half the room; products are of doubles."""
    kind = df.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    rows = df.filter(F.col(id).isNotNull() & fits).select(F.col(id).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """Lists as rows of doubles, filled up with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(values) == len(column) * length:
        return values.reshape(-1, length)
    sizes = np.fromiter((len(x) for x in column), dtype=np.int64, count=len(column))
    out = np.zeros((len(column), length))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hadamard(y: np.ndarray) -> np.ndarray:
    """The Hadamard transform of rows whose length is a power of two, by factors of up to 16."""
    size, done = y.shape[1], 1
    while done < size:
        r = min(16, size // done)
        block = np.ones((1, 1))
        while len(block) < r:
            block = np.block([[block, block], [block, -block]])
        # Each step turns the last factor and brings it to the front, so that all are in place at the end.
        y = (y.reshape(-1, r) @ block).reshape(len(y), size // r, r).swapaxes(1, 2).reshape(len(y), size)
        done *= r
    return y


class Rotations:
    """The pseudo-rotations of all tables, two for each, for vectors of one length."""

    def __init__(self, length: int, tables: int, seed: int = SEED, most: int = BUCKETS):
        self.length, self.tables, self.size = length, tables, 1 << max(0, length - 1).bit_length()
        self.second = max(1, min(self.size, most // (4 * self.size)))
        self.buckets = 4 * self.size * self.second
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(2 * tables, 3, self.size))

    def turned(self, x: np.ndarray, rotation: int) -> np.ndarray:
        """x (rows of unit vectors) after a rotation."""
        y = np.zeros((len(x), self.size))
        y[:, : self.length] = x
        for signs in self.signs[rotation]:
            y = hadamard(y * signs) / np.sqrt(self.size)
        return y

    def both(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        return self.turned(x, 2 * table), self.turned(x, 2 * table + 1)[:, : self.second]

    def hashes(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each row: axis i is 2 i where it points ahead, else 2 i + 1."""
        axes = []
        for y in self.both(x, table):
            i = np.abs(y).argmax(axis=1)
            axes.append(2 * i + (y[np.arange(len(y)), i] < 0))
        return axes[0] * 2 * self.second + axes[1]

    def probes(self, x: np.ndarray, table: int, held: np.ndarray, wanted: int) -> list[np.ndarray]:
        """The buckets that each row probes: in order, those that hold anything, until wanted are held."""
        near, places = [], []
        for y in self.both(x, table):
            signed = np.empty((len(y), 2 * y.shape[1]))
            signed[:, 0::2], signed[:, 1::2] = y, -y
            place = np.argsort(-signed, axis=1, kind="stable")
            near.append(np.take_along_axis(signed, place, axis=1))
            places.append(place)
        total = int(held.sum())
        most = min(self.buckets, max(64, 2 * self.buckets * wanted // max(1, total)))
        while True:
            # The pair of the i-th and j-th axes comes after all (i + 1) (j + 1) - 1 pairs of nearer ones.
            i, j = np.nonzero(np.outer(np.arange(1, 2 * self.size + 1), np.arange(1, 2 * self.second + 1)) <= most)
            sums = near[0][:, i] + near[1][:, j]
            first = np.argpartition(-sums, most - 1, axis=1)[:, :most] if most < len(i) else np.broadcast_to(np.arange(len(i)), sums.shape)
            first = np.take_along_axis(first, np.argsort(-np.take_along_axis(sums, first, axis=1), axis=1, kind="stable"), axis=1)
            bucket = np.take_along_axis(places[0], i[first], axis=1) * (2 * self.second) + np.take_along_axis(places[1], j[first], axis=1)
            holds = held[bucket]
            got = np.cumsum(holds, axis=1)
            if most == self.buckets or (got[:, -1] >= wanted).all():
                take = (holds > 0) & (got - holds < wanted)
                return [b[t] for b, t in zip(bucket, take, strict=True)]
            most = min(self.buckets, 4 * most)


def pack(held: np.ndarray, slice_: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first group, number of slices) of every bucket of every table, and the number of groups. Each slice
    of a bucket that is cut has a group of its own."""
    first, cuts = np.zeros_like(held), np.maximum(1, -(-held // slice_))
    groups = 0
    for t in range(len(held)):
        small = np.where(cuts[t] == 1, held[t], 0)
        first[t] = groups + (np.cumsum(small) - small) // slice_
        groups = int(first[t].max(initial=groups)) + 1
        for b in np.flatnonzero(cuts[t] > 1):
            first[t, b] = groups
            groups += int(cuts[t, b])
    return first, cuts, groups


class Met:
    """A group's vectors, by bucket, for queries that come in blocks."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, buckets: np.ndarray, x: np.ndarray):
        order = np.argsort(buckets, kind="stable")
        self.rows, self.ids, self.buckets, self.x = rows[order], ids[order], buckets[order], x[order]
        self.norm = float(np.linalg.norm(x, axis=1).max(initial=0.0))

    def best(self, rows: np.ndarray, floors: np.ndarray, q: np.ndarray, probes: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, place, score) of the k best rows of each query among its probes. Products
        of blocks only select; a score is a sum in one order, so that equal vectors score equally."""
        who = np.repeat(np.arange(len(q)), [len(p) for p in probes])
        bucket = np.concatenate(probes) if len(probes) else np.empty(0, np.int64)
        low, high = np.searchsorted(self.buckets, bucket), np.searchsorted(self.buckets, bucket, side="right")
        slack = np.linalg.norm(q, axis=1) * self.norm * 1e-12
        found, pairs = [], max(1, ROOM // max(1, q.shape[1]))

        def select(i: np.ndarray, at: np.ndarray, scores: np.ndarray) -> None:
            keep = (scores >= floors[i] - slack[i]) & (rows[i] != self.rows[at])
            found.append((i[keep], at[keep]))

        # Small buckets row by row, large ones as products of blocks.
        large = high - low >= 64
        n = np.where(large, 0, high - low)
        ends = np.cumsum(n)
        edges = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(n.sum()), pairs), side="right"), len(n)))
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            some = slice(first, last)
            i = np.repeat(who[some], n[some])
            at = np.arange(len(i)) + np.repeat(low[some] - (np.cumsum(n[some]) - n[some]), n[some])
            select(i, at, np.einsum("ij,ij->i", q[i], self.x[at]))
        for start in np.unique(low[large]).tolist():
            probing = large & (low == start)
            some, stop = who[probing], int(high[probing][0])
            step = max(1, pairs // (stop - start))
            for a in range(0, len(some), step):
                block = some[a : a + step]
                i, j = np.divmod(np.arange(len(block) * (stop - start)), stop - start)
                select(block[i], j + start, (q[block] @ self.x[start:stop].T).ravel())
        who, at = (np.concatenate([f[c] for f in found] or [np.empty(0, np.int64)]) for c in (0, 1))
        score = np.concatenate([(self.x[at[s : s + pairs]] * q[who[s : s + pairs]]).sum(axis=1) for s in range(0, len(at), pairs)] or [np.empty(0)])
        order = np.lexsort((self.ids[at], -score, who))
        who, at, score = who[order], at[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        return who[place < k], at[place < k], score[place < k]


def grouped(batches: Iterator[pa.RecordBatch], column: str = "group") -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(group, whether of queries, rows) of rows sorted by group and query, in their order."""
    for batch in batches:
        group, query = batch.column(column).to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((group[1:] != group[:-1]) | (query[1:] != query[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
            if b > a:
                yield int(group[a]), bool(query[a]), batch.slice(a, b - a)


def search(df: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", tables: int = TABLES, width: float = WIDTH, slice_: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found, by inner product."""
    rows = vector_rows(df, valid(F.col(vector)), is_query, id, vector)
    total, length = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    turn = Rotations(max(1, length or 0), tables)
    length = turn.length
    wanted = max(k + 1, int(width * total**GROWTH))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((tables, turn.buckets), dtype=np.int64)
        for batch in batches:
            x = unit(matrix(batch.column("v"), length))
            for t in range(tables):
                held[t] += np.bincount(turn.hashes(x, t), minlength=turn.buckets)
        t, bucket = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(bucket), pa.array(held[t, bucket])], names=["t", "bucket", "n"])

    # One row for each table and bucket: their number depends on the vectors' length alone.
    counts = rows.select("v").mapInArrow(counted, "t long, bucket long, n long").groupBy("t", "bucket").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros((tables, turn.buckets), dtype=np.int64)
    held[counts["t"].to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    first, cuts, _ = pack(held, slice_)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("row", "v").toArrow()
    sample_rows = drawn.column("row").to_numpy()
    sample = matrix(drawn.column("v").combine_chunks(), length) if len(sample_rows) else np.empty((0, length))
    sample_hashes = np.array([turn.hashes(unit(sample), t) if len(sample) else np.empty(0, np.int64) for t in range(tables)])
    names = ["group", "query", "row", "id", "floor", "buckets", "v"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, row = unit(matrix(batch.column("v"), length)), batch.column("row").to_numpy()
            mixed = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for t in range(tables):
                bucket = turn.hashes(x, t)
                group = first[t, bucket] + mixed % cuts[t, bucket]
                own = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.zeros(len(x), bool)), batch.column("row"), batch.column("id"), pa.array(np.zeros(len(x))), own, batch.column("v")], names=names)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                raw, row = matrix(batch.column("v"), length), batch.column("row").to_numpy()
                x = unit(raw)
                probes = [turn.probes(x, t, held[t], wanted) for t in range(tables)]
                # The k-th best of the sample's rows in a query's own probes bounds its k-th score.
                meets, probed_here = np.zeros((len(x), len(sample_rows)), dtype=bool), np.zeros(turn.buckets, dtype=bool)
                for t in range(tables):
                    for i, p in enumerate(probes[t]):
                        probed_here[p] = True
                        meets[i] |= probed_here[sample_hashes[t]]
                        probed_here[p] = False
                scores = np.where(meets & (sample_rows[None, :] != row[:, None]), raw @ sample.T, -np.inf)
                floors = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] > k else np.full(len(x), -np.inf)
                floors = floors - np.abs(floors) * 1e-9 if len(floors) else floors
                floors = np.where(np.isnan(floors), -np.inf, floors)
                for t in range(tables):
                    who = np.repeat(np.arange(len(x)), [len(p) for p in probes[t]])
                    bucket = np.concatenate(probes[t])
                    n = cuts[t, bucket]
                    part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    who, bucket = np.repeat(who, n), np.repeat(bucket, n)
                    group = first[t, bucket] + part
                    order = np.lexsort((bucket, group, who))
                    who, bucket, group = who[order], bucket[order], group[order]
                    edge = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (group[1:] != group[:-1])]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(who)).astype(np.int32)), pa.array(bucket.astype(np.int32)))
                    at = pa.array(who[edge])
                    yield pa.RecordBatch.from_arrays([pa.array(group[edge]), pa.array(np.ones(len(edge), bool)), batch.column("row").take(at), batch.column("id").take(at), pa.array(floors[who[edge]]), lists, batch.column("v").take(at)], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, vectors, met = None, [], None
        for group, query, batch in grouped(batches):
            if group != last:
                last, vectors, met = group, [], None
            if not query:
                vectors.append(batch)
                continue
            if not vectors and met is None:
                continue
            if met is None:
                whole = pa.Table.from_batches(vectors).combine_chunks()
                vectors = []
                met = Met(whole.column("row").to_numpy(), whole.column("id").to_numpy(), whole.column("buckets").chunk(0).flatten().to_numpy(), matrix(whole.column("v").chunk(0), length))
            for start in range(0, batch.num_rows, BLOCK):
                some = batch.slice(start, BLOCK)
                row, ids, lists = some.column("row").to_numpy(), some.column("id").to_numpy(), some.column("buckets")
                who, at, score = met.best(row, some.column("floor").to_numpy(), matrix(some.column("v"), length), [x.values.to_numpy() for x in lists], k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row[who], ids[who], met.rows[at], met.ids[at], score)], names=["query", "query_id", "row", "vec_id", "score"])

    own = rows.schema["v"].dataType.simpleString()
    shape = f"group long, query boolean, row long, id long, floor double, buckets array<int>, v {own}"
    both = rows.select("row", "id", "v").mapInArrow(dealt, shape).union(rows.filter("q").select("row", "id", "v").mapInArrow(probed, shape))
    found = both.repartition("group").sortWithinPartitions("group", "query").mapInArrow(meet, "query long, query_id long, row long, vec_id long, score double")
    # Several tables can find a row.
    answer = materialize(ranked(found.distinct(), k))
    discard(rows)
    return answer


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query among those found, each row once. Every group has kept k rows of a
    query at most, so that a query's rows are bounded by its probes."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
