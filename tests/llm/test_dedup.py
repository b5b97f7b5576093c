"""SimHash, components and substring removal against brute force."""

import collections
import hashlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillon.llm import components, fmindex, simhash


def naive_fp(text, k):
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def corpus(n=160, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 90)))) for _ in range(n)]
    for i in range(0, 60, 3):
        parts = texts[i].split()
        parts[int(rng.integers(len(parts)))] += "x"
        texts.append(" ".join(parts))
    passage = " ".join(rng.choice(words, 50))
    for i in range(20):
        texts.append(f"{texts[i]}\t{passage}  {texts[i + 20]}")
    texts += [texts[0]] * 4 + ["", " \n", None, "One", "ONE", "der " * 90, "a b c " * 60, "É é", " ".join(["long"] + words[:3000])]
    return [(1000 - i, t, "clash") for i, t in enumerate(texts)]


SHAPE = "doc_id long, text string, fp string"


def test_simhash(spark):
    rows = corpus()
    got = simhash.near_duplicates(spark.createDataFrame(rows, SHAPE), shard=30).collect()
    fp = {i: naive_fp(t, 3) for i, t, _ in rows}
    links = [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2]
    want = classes(fp, links)
    assert sorted(map(tuple, got)) == sorted((i, f"{fp[i]:016x}", want[i]) for i in fp)


def test_simhash_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b c", "x"), (None, "q r s t", "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SHAPE))
    assert sorted(map(str, (r["component_id"] for r in got.collect()))) == ["1", "1", "1", "None"]
    assert simhash.near_duplicates(spark.createDataFrame([], SHAPE)).count() == 0


def test_forest_spans_all_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([base[rng.integers(0, 40, 3000)] ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) for _ in range(2)]))
    d = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    want = classes(range(len(points)), zip(*(x.tolist() for x in np.nonzero(np.triu(d, 1))), strict=True))
    nodes = simhash.fit_top(points[::7], 60)
    found = []
    for _, rows, home in simhash.route(points, nodes, 2):
        found += [(int(rows[i]), int(rows[j])) for i, j in simhash.linked(points[rows], home, 2)]
    assert classes(range(len(points)), found) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (5, 5)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == classes({x for p in links for x in p}, links)


def test_representatives(spark):
    words = [f"w{i}" for i in range(300)]
    near = [*words]
    near[150] = "changed"
    rows = [(5, " ".join(words), "a"), (3, " ".join(near), "a"), (9, " ".join(words), "b"), (4, "another text that is alone here now", "c"), (4, "another text that is alone here now", "c"), (7, None, "d"), (8, "  ", "d"), (10, " ".join(words[:150] + ["x"] * 40 + words[:10][::-1] + [f"v{i}" for i in range(100)]), "e")]
    got = simhash.representatives(spark.createDataFrame(rows, SHAPE))
    assert got.columns == ["doc_id", "text", "fp"]
    assert sorted(r["doc_id"] for r in got.collect()) == [3, 4, 7, 10]


def test_representatives_of_repeated_text(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 10**6, 200)) for _ in range(12)]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(100 + i, f"{t} {t}", "a") for i, t in enumerate(texts)]
    assert sorted(r["doc_id"] for r in simhash.representatives(spark.createDataFrame(rows, SHAPE)).collect()) == list(range(12))


def test_representatives_by_exact_similarity(spark):
    rows = []
    for i in range(120):
        # 450 shingles each: 400 shared are a similarity of 0.8, 395 of 0.78.
        same = (400 if i % 2 else 395) + 4
        words = [f"w{i}.{j}" for j in range(454)]
        rows += [(2 * i, " ".join(words), "a"), (2 * i + 1, " ".join(words[:same] + [f"{w}x" for w in words[same:]]), "a")]
    got = {r["doc_id"] for r in simhash.representatives(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == {i for i, _, _ in rows if i % 4 != 3}


def test_confirmed_against_brute_force():
    rng = np.random.default_rng(9)
    base = [set(rng.integers(0, 2**62, 40).tolist()) for _ in range(4)]
    sets = [set(list(base[i % 4])[: rng.integers(25, 41)]) | set(rng.integers(0, 2**62, rng.integers(0, 12)).tolist()) for i in range(80)]
    links = [(i, j) for i in range(80) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    got = simhash.confirmed([np.array(sorted(s), dtype=np.uint64) for s in sets], 0.8)
    assert dict(enumerate(got.tolist())) == classes(range(80), links)


def shingles(text):
    w = text.split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_representatives_come_from_near_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(300):
        words = [f"w{k}" for k in rng.integers(0, 10**6, 600)]
        other = [*words]
        other[int(rng.integers(600))] = "changed"
        rows += [(2 * i, " ".join(words), "a"), (2 * i + 1, " ".join(other), "a")]
    # The same set of shingles in another text, and a text without any word.
    rows += [(700, "a b c d e f " * 20, "a"), (701, "a b c d e f " * 30, "a"), (702, " ", "a"), (703, None, "a")]
    sets = {i: shingles(t) if t and t.strip() else set() for i, t, _ in rows}
    hashes = {i: [xxhash.xxh64_intdigest(s.encode(), 42) for s in x] for i, x in sets.items()}
    fp = {i: sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) for i, h in hashes.items()}
    pairs = [(i, i + 1) for i in range(0, 704, 2) if i in fp]
    # Without the shards of least shingles, the vantage-point tree alone finds those within two bits.
    monkeypatch.setattr(simhash, "_candidates", lambda similarity: lambda batches: iter(()))
    got = {r["doc_id"] for r in simhash.representatives(spark.createDataFrame(rows, SHAPE), shard=100).collect()}
    near = {b for a, b in pairs if (fp[a] ^ fp[b]).bit_count() <= 2}
    assert {701, 703} <= near and 50 < len(near) < 290
    assert got == set(fp) - near
    monkeypatch.undo()
    got = {r["doc_id"] for r in simhash.representatives(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == set(fp) - {b for _, b in pairs}


def test_candidates_have_near_fingerprints():
    signatures = np.ones((4, simhash.BINS), dtype=np.uint8)
    points = np.array([0, 2**simhash.WIDE - 1, 2**64 - 1, 2**64 - 2], dtype=np.uint64)
    assert simhash.estimated(points, signatures, 0.8).tolist() == [0, 0, 2, 2]
    # Pairs of the least sets with a similarity of 0.8 differ most; none is lost.
    rng = np.random.default_rng(8)
    for _ in range(2000):
        words = [f"w{k}" for k in rng.integers(0, 10**6, 9)]
        a, b = (simhash._sketch(" ".join(words[:n]), 5)[0] for n in (8, 9))
        assert (a ^ b).bit_count() <= simhash.WIDE


def test_repeats_do_not_move_a_fingerprint(spark):
    rng = np.random.default_rng(13)
    rows = []
    for i in range(40):
        words = [f"w{k}" for k in rng.integers(0, 10**6, 400)]
        rows += [(2 * i, " ".join(words), "a"), (2 * i + 1, " ".join(words + words[-20:] * 200), "a")]
    assert sorted(r["doc_id"] for r in simhash.representatives(spark.createDataFrame(rows, SHAPE)).collect()) == list(range(0, 80, 2))


def naive_repeats(rows, window):
    words = [(i, t.encode().split() if t else []) for i, t, _ in rows]
    count = collections.Counter(tuple(w[j : j + window]) for _, w in words for j in range(len(w) - window + 1))
    out = []
    for i, w in words:
        keep = np.ones(len(w), dtype=bool)
        for j in range(len(w) - window + 1):
            if count[tuple(w[j : j + window])] > 1:
                keep[j : j + window] = False
        kept = [w[k] for k in np.flatnonzero(keep)]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(spark):
    rows = corpus(seed=4)
    rows += [(None, rows[3][1], "x"), (77, rows[5][1], "x"), (77, rows[5][1], "x")]
    df = spark.createDataFrame(rows, SHAPE)
    for settings in ({}, {"frequent": 3, "shard_words": 500}):
        got = fmindex.digests(df, window=35, **settings).collect()
        assert sorted(map(tuple, got), key=str) == naive_repeats(rows, 35)
    short = fmindex.digests(df, window=12, gram=4).collect()
    assert sorted(map(tuple, short), key=str) == naive_repeats(rows, 12)


def test_substring_dedup_splits_at_all_white_space(spark):
    passage = [f"p{i}" for i in range(50)]
    texts = [" " + " ".join(["one", *passage, "two"]), " ".join(["three", *passage, "four"]), "x\ry z " + " ".join(passage)]
    texts += [f"{w}five{c}six {' '.join(passage[:45])}{c}seven{w}" for w, c in (("a", "\x0b"), ("b", "\x0c"))]
    # Not white space in bytes, though str.split() cuts there.
    texts.append("eight\x1cnine " + " ".join(passage))
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = fmindex.digests(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted(map(tuple, got), key=str) == naive_repeats(rows, 35)
    kept = fmindex.remove_repeats(spark.createDataFrame(rows, SHAPE)).collect()
    assert [r["text"] for r in sorted(kept)] == ["one two", "three four", "x y z", "afive sevena", "bfive sevenb", "eight\x1cnine"]


def test_substring_removal_keeps_the_rest(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"one  two\n{passage} three", "k"), (2, f"{passage} four", "k"), (3, "five  six", None), (4, None, None)]
    got = {r["doc_id"]: r for r in fmindex.remove_repeats(spark.createDataFrame(rows, SHAPE)).collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: "one two three", 2: "four", 3: "five  six", 4: None}
    assert fmindex.digests(spark.createDataFrame([], SHAPE)).count() == 0


def test_index_counts():
    rng = np.random.default_rng(0)
    text = np.concatenate([rng.integers(1, 4, 300), [0], rng.integers(1, 4, 200), [0]])
    index = fmindex.FMIndex(text, 16)
    for n in (1, 3, 8):
        for at in range(0, 280, 17):
            pattern = text[at : at + n]
            low, high = np.array([0]), np.array([index.n])
            for c in pattern[::-1]:
                low, high = index.extend(np.array([c]), low, high)
            assert high[0] - low[0] == sum((text[i : i + n] == pattern).all() for i in range(len(text) - n + 1))
