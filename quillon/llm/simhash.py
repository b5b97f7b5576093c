"""SimHash near-duplicates, linked exactly within a Hamming radius by vantage-point trees.

A text's fingerprint has a bit set if over half the XXH64 values of its word shingles have it. Distinct
fingerprints are dealt to shards by the top of a vantage-point tree (fitted on a bounded sample): at a
vantage point v with median distance m, those nearer than m go left, the others right, and one whose
distance is within the radius of the boundary visits the other side as a query too. Each shard
continues the tree over its own fingerprints, prunes by the same triangle bounds and compares what is
left in its leaves. A shard returns a spanning forest of its links, so that a dense group costs as many
rows as it has members. Components of all links follow by joins.

Defined results: a null, empty or wordless text has fingerprint 0, linked like any other; a text shorter
than a shingle counts as one shingle, a long one is read whole; a bit that half the hashes have is 0; every
row has a component, rows with a null id take part in linking, and a component without any id has
component_id null. Repeated rows are answered once each; an empty table gives no rows. Other columns, whatever
their names, are ignored, or kept by representatives().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, claim, discard, materialize, quoted, slices
from .components import components

#: Fingerprints that a shard aims at, and the most shards. The top of the tree is fitted on 64
#: fingerprints for each shard, SAMPLE at most (2 MB).
SHARD, SHARDS, SAMPLE = 20_000, 1 << 16, 1 << 18
#: Residents at which the tree ends.
LEAF = 48
#: Shingles that are hashed at a time.
BLOCK = 1 << 16
_BITS = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles of a text, A-Z lower-cased, block by block."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return
    n = max(1, len(words) - width + 1)
    if len(words) <= width:
        yield np.array([xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
        return
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()[width - 1 :]
    for at in range(0, n, BLOCK):
        yield np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[at : min(n, at + BLOCK)], ends[at : at + BLOCK], strict=False)], dtype=np.uint64)


def fingerprint(text: str | None, width: int) -> int:
    total, counts = 0, np.zeros(64, dtype=np.int64)
    for h in shingle_hashes(text, width):
        total += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((counts * 2 > total).astype(np.uint64) << _BITS).sum(dtype=np.uint64)) if total else 0


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 3) -> DataFrame:
    """The kept columns and fp, the fingerprint's 64 bits as a long."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, width) for t in batch.column("_whole").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(out.field(c).type) for c in keep] + [pa.array(found)], schema=out)

    return df.select(*keep, F.col(text).cast("string").alias("_whole")).mapInArrow(run, schema)


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _split(points: np.ndarray, tries: int = 4) -> tuple[np.uint64, int] | None:
    """A vantage point among the points and the distance that halves them best; None if none splits."""
    best = None
    for k in range(tries):
        v = points[(k * 2654435761 + len(points) // 2) % len(points)]
        d = _distance(points, v)
        for m in {int(np.median(d)), int(np.median(d)) + 1}:
            low = int((d < m).sum())
            low = min(low, len(points) - low)
            if low and (best is None or low > best[0]):
                best = (low, v, m)
    return best and (best[1], best[2])


def fit_top(points: np.ndarray, leaf: int) -> list[tuple[int, int, int, int]]:
    """The top of the tree: nodes (vantage point, m, left, right); a negative child is shard -1 - child."""
    nodes: list[tuple[int, int, int, int]] = []
    shards = 0

    def grow(own: np.ndarray) -> int:
        nonlocal shards
        cut = _split(own) if len(own) > leaf else None
        if cut is None:
            shards += 1
            return -shards
        v, m = cut
        near = _distance(own, v) < m
        at = len(nodes)
        nodes.append((int(v), m, 0, 0))
        nodes[at] = (int(v), m, grow(own[near]), grow(own[~near]))
        return at

    grow(points)
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indexes of points, whether each is resident): each point lives in one shard and visits
    those that its ball reaches beyond a boundary."""
    stack = [(0 if nodes else -1, np.arange(len(points)), np.ones(len(points), dtype=bool))]
    while stack:
        node, rows, home = stack.pop()
        if not len(rows):
            continue
        if node < 0:
            yield -1 - node, rows, home
            continue
        v, m, left, right = nodes[node]
        d = _distance(points[rows], np.uint64(v))
        near = d < m
        to_left, to_right = d - radius < m, d + radius >= m
        # Residents left of the boundary look across it; those right of it are found by them.
        to_left &= near | ~home
        stack.append((left, rows[to_left], (home & near)[to_left]))
        stack.append((right, rows[to_right], (home & ~near)[to_right]))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def linked(points: np.ndarray, home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links within the radius that touch a resident."""
    forest, edges = _Forest(len(points)), []
    residents, visitors = np.flatnonzero(home), np.flatnonzero(~home)
    stack = [(residents, visitors)]
    while stack:
        own, guests = stack.pop()
        if len(own) == 0 or len(own) + len(guests) < 2:
            continue
        cut = _split(points[own]) if len(own) > LEAF else None
        if cut is None:
            everyone = np.concatenate([own, guests])
            for at in range(0, len(everyone), 1 << 14):
                block = everyone[at : at + (1 << 14)]
                for first in range(0, len(own), LEAF):
                    some = own[first : first + LEAF]
                    a, b = np.nonzero(_distance(points[block][:, None], points[some][None, :]) <= radius)
                    for i, j in zip(block[a].tolist(), some[b].tolist(), strict=True):
                        if i != j and forest.join(i, j):
                            edges.append((i, j))
            continue
        v, m = cut
        d, g = _distance(points[own], v), _distance(points[guests], v)
        near = d < m
        across = own[near & (d + radius >= m)]
        stack.append((own[near], guests[g - radius < m]))
        stack.append((own[~near], np.concatenate([guests[g + radius >= m], across])))
    return edges


def links(distinct: DataFrame, radius: int = 2, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints (column fp, distinct) at
    most radius bits apart."""
    total = distinct.count()
    # Smaller tables have a few shards for each core.
    spread = min(4 * distinct.sparkSession.sparkContext.defaultParallelism, total // 500)
    wanted = min(SHARDS, max(1, -(-total // shard), spread))
    # The least hashes are a sample that does not depend on how the rows are dealt.
    drawn = [r[0] for r in distinct.select("fp", F.xxhash64("fp").alias("h")).orderBy("h", "fp").limit(min(sample, 64 * wanted)).collect()] if wanted > 1 else []
    nodes = fit_top(np.array(drawn, dtype=np.int64).view(np.uint64), -(-len(drawn) // wanted)) if drawn else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            for k, rows, home in route(points, nodes, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, dtype=np.int32)), pa.array(points[rows].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        points = rows["fp"].to_numpy().view(np.uint64)
        found = linked(points, rows["home"].to_numpy(), radius)
        a, b = (rows["fp"].to_numpy()[[e[k] for e in found]] if found else np.empty(0, np.int64) for k in (0, 1))
        return pd.DataFrame({"a": a, "b": b})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", doc: str = "doc_id", width: int = 3, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """doc, fingerprint (16 hex digits) and component_id, the least id reachable over links, for every row."""
    rows = materialize(fingerprints(df.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")), "_text", ("_doc",), width))
    distinct = materialize(rows.groupBy("fp").agg(F.min("_doc").alias("least")))
    reached = components(links(distinct, radius, shard=shard))
    joined = materialize(distinct.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    # Written, as before the join by star: a giant component and a hot fingerprint are split.
    ids = materialize(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = materialize(joined.hint("merge").join(ids.hint("merge"), "root").select("fp", "component_id"))
    discard(distinct, joined, ids)
    return rows.hint("merge").join(classes.hint("merge"), "fp").select(F.col("_doc").alias(doc), hex16(F.col("fp")).alias("fingerprint"), "component_id")


# --- similar texts ----------------------------------------------------------------------------------
# Candidates are texts with near fingerprints, here of the set of shingles, since how often a text repeats
# one does not matter for a Jaccard similarity. Those within a few bits are found as above, by the
# vantage-point tree over all fingerprints. A similarity of 0.8 allows for more bits: 10 of 64 are expected,
# 12 if four of five shingles are shared, and WIDE are exceeded by about one of a million such pairs. At
# that radius triangle bounds prune nothing, so that such texts are looked for where they share their least
# shingles in one of many orders: each of VIEWS orders deals a text to the shard of its LEAST least shingles.
# A pair with a similarity of 0.8 misses all 16 shards with a probability of about 0.00002 (0.0003 for four
# shingles of five). Texts of one shard are candidates if their fingerprints differ in WIDE bits at most and
# a signature of BINS least shingles, one of each range of hash values, agrees with the similarity up to
# MARGIN, seven times its standard error at 0.8. The components of the candidates then get their members'
# whole sets of shingles, and texts link if the Jaccard similarity of these is high enough.

VIEWS, LEAST, BINS, MARGIN, WIDE = 16, 3, 128, 0.25, 28
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(57)


def _sketch(text: str | None, width: int) -> tuple[int, int, list[int], bytes]:
    """Fingerprint of the set of shingles, number of shingles, shard of each view and signature of a text."""
    blocks = list(shingle_hashes(text, width))
    if not blocks:
        return 0, 0, [], bytes(BINS)
    total, counts, least = sum(map(len, blocks)), np.zeros(64, dtype=np.int64), np.empty((VIEWS, 0), dtype=np.uint64)
    lowest = np.full(BINS, 2**64 - 1, dtype=np.uint64)
    factors = (np.arange(VIEWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    ordered = np.unique(np.concatenate(blocks))
    for at in range(0, len(ordered), BLOCK):
        counts += np.unpackbits(ordered[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    at = np.searchsorted(ordered, _EDGES)
    there = np.flatnonzero(at < len(ordered))
    there = there[ordered[at[there]] >> np.uint64(57) == there.astype(np.uint64)]
    lowest[there] = ordered[at[there]]
    for start in range(0, len(ordered), 4096):
        some = ordered[start : start + 4096][None, :] * factors[:, None]
        some ^= some >> np.uint64(31)
        some = np.concatenate([least, some * np.uint64(0x94D049BB133111EB)], axis=1)
        least = np.sort(np.partition(some, LEAST - 1, axis=1)[:, :LEAST] if some.shape[1] > LEAST else some, axis=1)
    key = np.arange(1, VIEWS + 1, dtype=np.uint64)
    for k in range(least.shape[1]):
        key = (key ^ least[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    fp = int(((counts * 2 > len(ordered)).astype(np.uint64) << _BITS).sum(dtype=np.uint64))
    # One byte of each bin's least value, 0 for an empty bin.
    signature = np.where(lowest == np.uint64(2**64 - 1), 0, lowest % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return fp, total, key.view(np.int64).tolist(), signature.tobytes()


def _classes(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first member of each member's class; near tells which of some members link to one."""
    first, left = np.arange(n), np.arange(n)
    while len(left):
        start, left, reach = left[0], left[1:], [left[0]]
        while reach and len(left):
            hit = near(reach.pop(), left)
            first[left[hit]] = start
            reach += left[hit].tolist()
            left = left[~hit]
    return first


def estimated(points: np.ndarray, signatures: np.ndarray, similarity: float) -> np.ndarray:
    """The first member of each member's class of texts whose fingerprints (points) differ in WIDE bits at most
    and whose signatures may have that similarity."""

    def near(i: int, others: np.ndarray) -> np.ndarray:
        out = _distance(points[others], points[i]) <= WIDE
        a, close = signatures[i], np.flatnonzero(out)
        for at in range(0, len(close), BLOCK):
            some = close[at : at + BLOCK]
            b = signatures[others[some]]
            out[some] = ((a == b) & (a > 0)).sum(axis=1) >= (similarity - MARGIN) * ((a > 0) | (b > 0)).sum(axis=1)
        return out

    return _classes(len(signatures), near)


def confirmed(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first member of each member's class of sets (distinct values) linked by their exact Jaccard
    similarity. Postings of each value count what a set shares with all others."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[np.argsort(number, kind="stable")]
    until = np.cumsum(np.bincount(number, minlength=len(values)))

    def near(i: int, others: np.ndarray) -> np.ndarray:
        shared = np.zeros(len(sets), dtype=np.int64)
        mine = number[ends[i] - sizes[i] : ends[i]]
        from_, to = np.where(mine > 0, until[mine - 1], 0), until[mine]
        for at in range(0, len(mine), 64):
            n = (to - from_)[at : at + 64]
            place = np.arange(int(n.sum())) + np.repeat(from_[at : at + 64] - (np.cumsum(n) - n), n)
            shared += np.bincount(owner[place], minlength=len(sets))
        common = shared[others]
        return common >= similarity * (sizes[i] + sizes[others] - common) - 1e-9

    return _classes(len(sets), near)


def sketches(df: DataFrame, text: str, keep: tuple[str, ...], width: int) -> DataFrame:
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("views", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash", lambda: None)
        for batch in slices(batches):
            found = [_sketch(t, width) for t in batch.column("_text").to_pylist()]
            fp = pa.array(np.array([f[0] for f in found], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(out.field(c).type) for c in keep] + [fp, pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], out.field("views").type), pa.array([f[3] for f in found], pa.binary())], schema=out)

    return df.select(*keep, df[text].cast("string").alias("_text")).mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[pa.RecordBatch]]:
    """The runs of rows with one value in a column that the rows are sorted by."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        value = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            if held and value[a] != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = value[a]
    if held:
        yield held


def _candidates(similarity: float):
    """A forest of the candidates within each run of rows with one view (rows are sorted by view)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, "view"):
            rows = pa.Table.from_batches(held)
            if rows.num_rows < 2:
                continue
            points = rows.column("fp").to_numpy().view(np.uint64)
            first = estimated(points, np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, BINS), similarity)
            j = np.flatnonzero(first != np.arange(len(first)))
            if len(j):
                k1, fp = (rows.column(c).to_numpy() for c in ("k1", "fp"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[first[j]], fp[first[j]], k1[j], fp[j])], names=["k1a", "fpa", "k1b", "fpb"])

    return run


def _confirmed_runs(width: int, similarity: float):
    """The class of each text within each component of candidates (rows are sorted by component)."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(np.concatenate(list(shingle_hashes(t, width)))) for t in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("node"), pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate(sets)))], names=["component", "node", "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(shingled(batches), "component"):
            nodes = [n for b in held for n in b.column("node").to_pylist()]
            first = confirmed([s.values.to_numpy() for b in held for s in b.column("set")], similarity)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array([nodes[i] for i in first.tolist()], pa.string())], names=["node", "root"])

    return run


def _close(texts: DataFrame, radius: int, shard: int) -> DataFrame:
    """Links of texts (columns k1, fp, n) whose fingerprints the vantage-point tree finds within the radius, equal
    ones among them. They lead over nodes of fingerprints; wordless texts take no part."""
    texts = texts.filter("n > 0").select("k1", "fp")
    distinct = materialize(texts.groupBy("fp").agg(F.count(F.lit(1)).alias("_m")))
    near = materialize(links(distinct.select("fp"), radius, shard=shard))
    met = near.select(F.col("a").alias("fp")).union(near.select("b")).union(distinct.filter("_m > 1").select("fp")).distinct()
    found = materialize(
        texts.hint("merge").join(met.hint("merge"), "fp").select(_node("k1", "fp").alias("a"), _node(None, "fp").alias("b")).union(near.select(_node(None, "a"), _node(None, "b")))
    )
    discard(distinct, near)
    return found


def _node(k: str | None, fp: str) -> Column:
    return F.concat(F.hex(k) if k else F.lit(""), F.lit("-"), F.hex(fp))


def representatives(df: DataFrame, text: str = "text", doc: str = "doc_id", width: int = 5, similarity: float = 0.8, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """df with one row of each class of near-duplicates, that of the least id. Texts link if their fingerprints
    are within the radius, or within WIDE bits in a view's shard, or others that lead from one to the other
    are, and their sets of shingles have that Jaccard similarity. Texts without a shingle (null, empty) are one class; of a class's rows with the least id, which
    may repeat, one stays; a class without any id keeps one row."""
    keyed = df.select(F.struct(*quoted(df.columns)).alias("row"), F.col(text).alias("text"), F.col(doc).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k1"), F.xxhash64(doc).alias("_k2"))
    rows = materialize(sketches(keyed.select("text", "id", F.col("_k1").alias("k1"), F.col("_k2").alias("k2")), "text", ("id", "k1", "k2"), width))
    texts = materialize(rows.groupBy("k1", "fp", "n").agg(F.min(F.struct("id", "k2", "views", "sig")).alias("least")))
    views = texts.select(F.explode("least.views").alias("view"), "k1", "fp", F.col("least.sig").alias("sig"))
    shared = views.select("view").groupBy("view").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").select("view")
    met = views.hint("merge").join(shared.hint("merge"), "view").repartition("view").sortWithinPartitions("view")
    found = met.mapInArrow(_candidates(similarity), "k1a long, fpa long, k1b long, fpb long")
    close = _close(texts, radius, shard)
    alike = components(found.select(_node("k1a", "fpa").alias("a"), _node("k1b", "fpb").alias("b")).union(close)).withColumnRenamed("root", "component")
    named = texts.withColumn("node", _node("k1", "fp"))
    members = named.select("node", F.col("k1").alias("_k1"), F.col("least.k2").alias("_k2")).hint("merge").join(alike.hint("merge"), "node")
    whole = keyed.select("_k1", "_k2", F.col("text").cast("string").alias("text")).hint("merge").join(members.hint("merge"), ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    dealt = whole.select("component", "node", "text").repartition("component").sortWithinPartitions("component", "node")
    reached = materialize(dealt.mapInArrow(_confirmed_runs(width, similarity), "node string, root string"))
    classes = named.hint("merge").join(reached.hint("merge"), "node", "left")
    # Wordless texts have fingerprint 0 and no view; they are one class whatever their white space.
    root = F.when(F.col("n") == 0, F.lit("")).otherwise(F.coalesce("root", "node"))
    stay = classes.groupBy(root.alias("root")).agg(F.min(F.struct("least", "k1")).alias("best")).select(F.col("best.k1").alias("_k1"), F.col("best.least.k2").alias("_k2"))
    stay = materialize(stay)
    discard(rows, texts, close, reached)
    kept = keyed.select("row", "_k1", "_k2").hint("merge").join(stay.hint("merge"), ["_k1", "_k2"])
    return kept.dropDuplicates(["_k1", "_k2"]).select("row.*")


def hex16(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
