"""Exact top-k inner products by best-first search in M-trees.

Vectors are dealt to the cells of a bounded set of pivots; a cell's pivot and covering radius form the
root page, and each cell (cut into slices of bounded size) is an M-tree of paged nodes with routing
objects, covering radii and distances to the parent. A ball of radius r around c holds no inner product
with q above q.c + |q| r, and none above (|q|^2 + n^2 - d^2) / 2, where n bounds the norms in it and d
is the least distance that the stored parent distances allow, so many need not be computed. A query's
k-th score over a bounded sample of the rows is a floor; it visits every cell whose bound reaches that
floor, and in a tree the nodes whose bound reaches the k-th score so far, best first. A task holds one
tree at a time, built once, and the queries stream past it.

Components become floor(scale * x). Scores are whole numbers, exact beyond 2^53 as well; outside 64
bits they are clipped to -(2^63 - 1) to 2^63 - 1. Defined results: vectors that are null or hold null or
non-finite components take no part, nor do rows with a null id; zero and empty vectors do, and shorter
vectors count as filled up with zeros; equal scores go to the smaller id. A query meets every row but its
own, so repeated rows are neighbours of each other and, as queries, are answered once each. An empty
table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .crosspoly import finite, grouped, matrix, ranked, vector_rows

#: Vectors that a cell aims at and a slice holds at most on average; the most pivots; vectors of the sample
#: that gives a floor.
CELL, PIVOTS, SAMPLE = 16_384, 1024, 4096
#: Entries of a leaf page and of an inner page.
LEAF, FANOUT = 512, 32
#: Relative slack of bounds in floating point.
SLACK = 1e-9


def exact_scores(x: np.ndarray, q: np.ndarray) -> list[int] | np.ndarray:
    """Inner products of whole numbers held as doubles."""
    top = np.abs(x).max(initial=0.0) * np.abs(q).max(initial=0.0) * max(1, len(q))
    if top < 2.0**53:
        return x @ q
    other = [int(b) for b in q]
    return [sum(int(a) * b for a, b in zip(row, other, strict=True)) for row in x]


class Node:
    """A page: its routing object, covering radius and largest norm, and either children or entries."""

    def __init__(self, center: np.ndarray, rows: np.ndarray, x: np.ndarray, norms: np.ndarray):
        d = np.linalg.norm(x[rows] - center, axis=1)
        self.center, self.radius, self.norm = center, float(d.max()), float(norms[rows].max())
        self.children: list[Node] = []
        self.to_parent = 0.0
        if len(rows) <= LEAF or self.radius == 0:
            self.rows, self.parent_distance = rows, d
            return
        self.rows = None
        n = min(FANOUT, -(-len(rows) // LEAF))
        pivots = x[rows[np.linspace(0, len(rows) - 1, max(2, n)).astype(int)]]
        near = ((pivots**2).sum(axis=1)[None, :] - 2 * x[rows] @ pivots.T).argmin(axis=1)
        parts = [rows[near == k] for k in range(len(pivots))]
        if max(map(len, parts)) == len(rows):  # no pivot tells them apart: cut at the median distance
            order = rows[np.argsort(d, kind="stable")]
            parts = [order[: len(order) // 2], order[len(order) // 2 :]]
        for part in parts:
            if len(part):
                middle = x[part].mean(axis=0)
                routing = x[part[((x[part] - middle) ** 2).sum(axis=1).argmin()]]
                child = Node(routing, part, x, norms)
                child.to_parent = float(np.linalg.norm(routing - center))
                self.children.append(child)
        self.child_centers = np.array([c.center for c in self.children])
        self.child_radii = np.array([c.radius for c in self.children])
        self.child_norms = np.array([c.norm for c in self.children])
        self.child_distances = np.array([c.to_parent for c in self.children])


class MTree:
    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None):
        self.x, self.ids, self.norms = x, ids, np.linalg.norm(x, axis=1)
        self.numbers = ids if rows is None else rows
        self.root = Node(x[0], np.arange(len(x)), x, self.norms) if len(x) else None
        self.computed = 0

    def search(self, q: np.ndarray, own: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, list]:
        """The k best (places, scores), leaving out the query's own row and scores below floor."""
        if self.root is None:
            return np.empty(0, np.int64), []
        norm = float(np.linalg.norm(q))
        best_at, best_scores = np.empty(0, np.int64), np.empty(0, object)
        kth = floor
        heap = [(-np.inf, 0, self.root, float(np.linalg.norm(q - self.root.center)))]
        tie = 0
        while heap:
            bound, _, node, d = heapq.heappop(heap)
            if -bound < kth:
                break
            slack = SLACK * (norm * (norm + node.norm) + 1)
            if node.rows is None:
                least = np.maximum(0.0, np.abs(d - node.child_distances) - node.child_radii)
                upper = (norm**2 + node.child_norms**2 - least**2) / 2 + SLACK * (norm + node.norm) ** 2
                open_ = np.flatnonzero(np.minimum(upper, norm * node.child_norms + slack) >= kth)
                if not len(open_):
                    continue
                centers = node.child_centers[open_]
                self.computed += len(open_)
                distances = np.linalg.norm(centers - q, axis=1)
                bounds = np.minimum(centers @ q + norm * node.child_radii[open_], upper[open_]) + slack
                for i, b, far in zip(open_.tolist(), bounds.tolist(), distances.tolist(), strict=True):
                    if b >= kth:
                        tie += 1
                        heapq.heappush(heap, (-b, tie, node.children[i], far))
                continue
            rows = node.rows
            upper = (norm**2 + self.norms[rows] ** 2 - (d - node.parent_distance) ** 2) / 2 + SLACK * (norm + node.norm) ** 2
            rows = rows[(upper >= kth) & (self.numbers[rows] != own)]
            if not len(rows):
                continue
            self.computed += len(rows)
            scores = exact_scores(self.x[rows], q)
            if isinstance(scores, np.ndarray):
                keep = scores >= kth
                rows, scores = rows[keep], scores[keep].astype(object)
            at = np.concatenate([best_at, rows])
            scores = np.concatenate([best_scores, np.array([int(s) for s in scores], dtype=object)])
            order = sorted(range(len(at)), key=lambda i: (-scores[i], self.ids[at[i]]))[:k]
            best_at, best_scores = at[order], scores[order]
            if len(order) == k:
                kth = max(floor, float(best_scores[-1]) - 1e-9 * abs(float(best_scores[-1])) * (abs(float(best_scores[-1])) >= 2.0**53))
        return best_at, best_scores.tolist()


def _clip(scores: list) -> list[int]:
    return [max(1 - 2**63, min(2**63 - 1, int(s))) for s in scores]


def search(df: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products over all other rows."""
    rows = vector_rows(df, finite(F.col(vector)), is_query, id, vector)
    total, length = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    length = max(1, length or 0)

    def whole(column: pa.Array) -> np.ndarray:
        return np.floor(scale * matrix(column, length))

    # Cells hold a cell's vectors at most on average; smaller tables have a few for each core.
    spread = min(2 * df.sparkSession.sparkContext.defaultParallelism, -(-total // (4 * LEAF)))
    wanted = max(1, min(PIVOTS, max(-(-total // cell), spread)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("row", "v").toArrow()
    sample_rows = drawn.column("row").to_numpy()
    sample = whole(drawn.column("v").combine_chunks()) if len(sample_rows) else np.zeros((0, length))
    pivots = sample[:wanted] if len(sample) else np.zeros((1, length))

    def nearest(x: np.ndarray) -> np.ndarray:
        return ((pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T).argmin(axis=1)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        for batch in batches:
            x = whole(batch.column("v"))
            at = nearest(x)
            n += np.bincount(at, minlength=len(pivots))
            np.maximum.at(r, at, np.linalg.norm(x - pivots[at], axis=1))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(r[some])], names=["cell", "n", "r"])

    # The root page: one entry for each pivot.
    page = rows.select("v").mapInArrow(measured, "cell long, n long, r double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("r").alias("r")).toPandas()
    cells, radii = page["cell"].to_numpy(dtype=np.int64), page["r"].to_numpy(dtype=np.float64)
    cuts = -(-page["n"].to_numpy(dtype=np.int64) // cell)
    cut_of = np.ones(len(pivots), dtype=np.int64)
    cut_of[cells] = cuts
    most = int(cut_of.max(initial=1))
    names = ["tree", "query", "row", "id", "floor", "v"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, row = nearest(whole(batch.column("v"))), batch.column("row").to_numpy()
            part = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % cut_of[at]
            yield pa.RecordBatch.from_arrays([pa.array(at * most + part), pa.array(np.zeros(len(at), bool)), batch.column("row"), batch.column("id"), pa.array(np.zeros(len(at))), batch.column("v")], names=names)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 1024):
                batch = big.slice(start, 1024)
                x, row = whole(batch.column("v")), batch.column("row").to_numpy()
                norm = np.linalg.norm(x, axis=1)[:, None]
                scores = np.where(sample_rows[None, :] != row[:, None], x @ sample.T, -np.inf)
                floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] > k else np.full(len(x), -np.inf)
                floor = np.where(np.isfinite(floor), floor - SLACK * (np.abs(floor) + norm[:, 0] ** 2 + 1), -np.inf)
                b = x @ pivots[cells].T + norm * radii[None, :]
                who, where = np.nonzero(b + SLACK * (np.abs(b) + norm**2 + 1) >= floor[:, None])
                n = cuts[where]
                part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                who, where = np.repeat(who, n), np.repeat(where, n)
                for at in range(0, len(who), 1 << 13):
                    some = who[at : at + (1 << 13)]
                    take = pa.array(some)
                    yield pa.RecordBatch.from_arrays([pa.array(cells[where[at : at + (1 << 13)]] * most + part[at : at + (1 << 13)]), pa.array(np.ones(len(some), bool)), batch.column("row").take(take), batch.column("id").take(take), pa.array(floor[some]), batch.column("v").take(take)], names=names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, vectors, tree = None, [], None
        for group, query, batch in grouped(batches, "tree"):
            if group != last:
                last, vectors, tree = group, [], None
            if not query:
                vectors.append(batch)
                continue
            if tree is None:
                held = pa.Table.from_batches(vectors).combine_chunks()
                vectors = []
                tree = MTree(whole(held.column("v").chunk(0)), held.column("id").to_numpy(), held.column("row").to_numpy())
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                row, ids, floors, x = some.column("row").to_numpy(), some.column("id").to_numpy(), some.column("floor").to_numpy(), whole(some.column("v"))
                who, places, scores = [], [], []
                for i in range(len(row)):
                    at, got = tree.search(x[i], row[i], k, floors[i])
                    who += [i] * len(at)
                    places += at.tolist()
                    scores += _clip(got)
                who, places = np.array(who, dtype=np.int64), np.array(places, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (row[who], ids[who], tree.numbers[places], tree.ids[places])] + [pa.array(scores, pa.int64())], names=["query", "query_id", "row", "vec_id", "score"])

    own = rows.schema["v"].dataType.simpleString()
    shape = f"tree long, query boolean, row long, id long, floor double, v {own}"
    both = rows.select("row", "id", "v").mapInArrow(dealt, shape).union(rows.filter("q").select("row", "id", "v").mapInArrow(visits, shape))
    found = both.repartition("tree").sortWithinPartitions("tree", "query").mapInArrow(answer, "query long, query_id long, row long, vec_id long, score long")
    result = materialize(ranked(found, k))
    discard(rows)
    return result
