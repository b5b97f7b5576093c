"""Vector searches against brute force."""

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import crosspoly, mtree

SHAPE = "vec_id long, embedding array<float>, score int"


def data(n=700, d=20, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[100:200] = x[100] + rng.normal(size=(100, d)).astype(np.float32) * 0.01
    x[200:230] = x[200]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    odd = [(n, None, 1), (n + 2, [float("nan")] * d, 1), (n + 3, [1.0] * (d - 1) + [None], 1), (None, [1.0] * d, 1), (n + 6, [float("inf")] + [1.0] * (d - 1), 1)]
    return x.astype(np.float64), rows + odd


def by_query(got):
    by = {}
    for r in got.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(found) for q, found in by.items()}


def truth(x, ids, own, k):
    """The k best rows of a row's query, by the literal rule."""
    s = (x * x[own]).sum(axis=1)
    return [i for i in np.lexsort((ids, -s)) if i != own][:k], s


def test_cross_polytope_recall_at_production_values(spark):
    x, rows = data(3000, 64)
    x = np.vstack([x, np.zeros((2, 64))])
    x[3000:, :2] = [[1.0, 2.0], [2.0, 1.0]]
    # A zero vector takes no part; short vectors count as filled up.
    rows += [(3000, [1.0, 2.0], 1), (3001, [2.0, 1.0], 1), (3020, [0.0] * 64, 1), (3040, [], 1)]
    got = by_query(crosspoly.search(spark.createDataFrame(rows, SHAPE), F.col("vec_id") % 20 == 0, k=20))
    assert set(got) == set(range(0, 3001, 20))
    hits = 0
    for q, found in got.items():
        best, s = truth(x, np.arange(3002), q, 20)
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(s[v] == sc and v != q for _, v, sc in found)
        assert [(-sc, v) for _, v, sc in found] == sorted((-sc, v) for _, v, sc in found)
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9


def test_cross_polytope_meets_a_falling_share():
    rng = np.random.default_rng(8)
    shares = []
    for n in (1000, 8000, 64_000):
        turn = crosspoly.Rotations(64, 1)
        hashes = np.concatenate([turn.hashes(crosspoly.unit(rng.normal(size=(8000, 64))), 0) for _ in range(-(-n // 8000))])[:n]
        held = np.bincount(hashes, minlength=turn.buckets)
        wanted = max(21, int(crosspoly.WIDTH * n**crosspoly.GROWTH))
        probes = turn.probes(crosspoly.unit(rng.normal(size=(50, 64))), 0, held, wanted)
        got = np.array([held[p].sum() for p in probes])
        assert (got >= wanted).all() and got.max() < wanted + held.max()
        shares.append(got.mean() * crosspoly.TABLES / n)
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.2


def test_groups_meet_all_that_is_probed(monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 6))
    buckets = np.concatenate([rng.integers(0, 200, 700), np.full(200, 7)])
    for room in (6 * 40, 1 << 21):
        monkeypatch.setattr(crosspoly, "ROOM", room)
        met = crosspoly.Met(np.arange(900), np.arange(900), buckets, x)
        q = np.concatenate([x[:30], rng.normal(size=(20, 6))])
        rows = np.concatenate([np.arange(30), np.full(20, -1)])
        probes = [rng.permutation(210)[: rng.integers(0, 60)] for _ in q]
        who, at, score = met.best(rows, np.full(50, -0.5), q, probes, 900)
        got = sorted(zip(who.tolist(), met.rows[at].tolist(), score.tolist(), strict=True))
        want = [(i, j, float(x[j] @ q[i])) for i in range(50) for j in range(900) if buckets[j] in set(probes[i].tolist()) and j != rows[i] and x[j] @ q[i] >= -0.5]
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_probes_come_in_order():
    rng = np.random.default_rng(4)
    turn = crosspoly.Rotations(10, 2)
    x = crosspoly.unit(rng.normal(size=(30, 10)))
    held = rng.integers(0, 3, turn.buckets)
    for t in range(2):
        first, second = turn.both(x, t)
        for r, probes in enumerate(turn.probes(x, t, held, 40)):
            signed = [np.stack([y[r], -y[r]], axis=1).ravel() for y in (first, second)]
            sums = (signed[0][:, None] + signed[1][None, :]).ravel()
            order = [b for b in np.argsort(-sums, kind="stable") if held[b]]
            end = int(np.searchsorted(np.cumsum(held[order]), 40)) + 1
            assert len(probes) == len(set(probes.tolist())) and np.allclose(sums[probes], sums[order[: len(probes)]])
            assert held[probes].all() and abs(len(probes) - end) <= 1


def test_hadamard():
    for size in (1, 2, 8, 32, 64, 512):
        block = np.ones((1, 1))
        while len(block) < size:
            block = np.block([[block, block], [block, -block]])
        x = np.random.default_rng(size).normal(size=(3, size))
        assert np.allclose(crosspoly.hadamard(x), x @ block)


def test_cross_polytope_cuts_hot_buckets(spark):
    x, rows = data(400, 16)
    rows = rows[:400] + [(1000 + i, rows[0][1], 1) for i in range(600)]
    x, ids = np.vstack([x, np.repeat(x[:1], 600, axis=0)]), np.array([r[0] for r in rows])
    got = by_query(crosspoly.search(spark.createDataFrame(rows, SHAPE), F.col("vec_id") % 20 == 0, k=10, slice_=64))
    assert len(got) == 50
    for q in (0, 1000, 1580):
        best, s = truth(x, ids, int(np.flatnonzero(ids == q)[0]), 10)
        assert got[q] == [(n + 1, int(ids[i]), s[i]) for n, i in enumerate(best)]


def test_cross_polytope_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (3, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], SHAPE)
    got = sorted(map(tuple, crosspoly.search(df, F.col("vec_id") % 20 == 0, k=20).collect()))
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 2, 0.0), (20, 3, 3, 0.0)]
    assert crosspoly.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_mtree_exact(spark):
    x, rows = data(seed=5)
    rows += [(700, [0.0] * 20, 1), (701, [1.0, 2.0], 1), (702, [], 1)]
    x = np.vstack([x, np.zeros((3, 20))])
    x[701, :2] = 1, 2
    # Columns of any names beside: group, tree, query, row.
    df = spark.createDataFrame([(*r, 1, 2, True, 3) for r in rows], SHAPE + ", group int, tree int, query boolean, row int")
    v = np.floor(256 * x)
    for cell in (60, 100_000):
        got = by_query(mtree.search(df, F.col("vec_id") % 50 == 0, k=5, cell=cell))
        assert set(got) == set(range(0, 701, 50))
        for q, found in got.items():
            best, s = truth(v, np.arange(703), q, 5)
            assert found == [(n + 1, i, int(s[i])) for n, i in enumerate(best)]


def test_mtree_prunes_and_counts_exactly():
    rng = np.random.default_rng(0)
    x = np.floor(np.concatenate([rng.normal(size=(2000, 4)) * 5 + c for c in rng.normal(size=(8, 4)) * 4000]))
    tree = mtree.MTree(x, np.arange(len(x)))
    q = x[17]
    ids, scores = tree.search(q, 17, 5)
    s = x @ q
    truth = [i for i in np.lexsort((np.arange(len(s)), -s)) if i != 17][:5]
    assert ids.tolist() == truth and scores == [int(s[i]) for i in truth]
    assert tree.computed < len(x) / 2
    big = np.array([[2.0**40, 1.0], [2.0**40, 3.0]])
    assert mtree.exact_scores(big, np.array([2.0**40, 1.0])) == [2**80 + 1, 2**80 + 3]


def test_mtree_empty(spark):
    assert mtree.search(spark.createDataFrame([], SHAPE), F.lit(True)).count() == 0


def test_repeated_rows_count_each(spark):
    rows = data()[1][:120]
    rows[7], rows[9] = ((i, [2 * a for a in rows[0][1]], 1) for i in (7, 9))
    rows += [rows[7]] * 6 + [rows[9]] * 2 + [rows[50]]
    ids = np.array([r[0] for r in rows])
    df = spark.createDataFrame(rows, SHAPE)
    for scale, search in ((256, mtree.search), (None, crosspoly.search)):
        v = np.array([r[1] for r in rows]) if scale is None else np.floor(scale * np.array([r[1] for r in rows]))
        for k in (5, 30):
            got = by_query(search(df, F.col("vec_id") % 50 == 0, k=k))
            for q in (0, 50, 100):
                best, s = truth(v, ids, q, k)
                want = [(n + 1, int(ids[i])) for n, i in enumerate(best)]
                # A query that is there twice is answered twice, and meets its copy.
                assert [f[:2] for f in got[q]] == sorted(want * int((ids == q).sum()))
