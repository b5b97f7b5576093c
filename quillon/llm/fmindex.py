"""Substring deduplication by FM-indexes.

Every window of so many consecutive words whose sequence also starts elsewhere is removed. An index of
all texts would have to be searched by all texts, so windows are first dealt by content: a window's
minimizer is the least hash among its word grams, and equal windows have equal minimizers. Runs of
windows whose minimizer occurs once need nothing more. The others go, as stretches of text, to the shard
of their minimizer, where each distinct stretch is put into an FM-index (suffix order up to a bounded
context, Burrows-Wheeler transform, wavelet matrix with packed bit vectors) and then streamed through it
by backward search: from a right end the match is extended to the left while at least two occurrences
remain, and intervals at least a window long are reported. Occurrences are counted exactly, since each
window of a text lies in one stretch.

Copies of a text, word by word, are represented by one of them. Windows under a minimizer that is very frequent
are dealt by their own hash instead, one by one, so that no shard holds a frequent passage's
surroundings; identical stretches are merged before the shuffle.

Defined results: null, empty and short texts have no windows and stay as they are; long texts are read
whole; repeated rows are copies of each other, rows with equal texts and null ids as well; no tie needs
deciding, since every occurrence of a repeated window goes; an empty table gives no rows; other columns pass
through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, claim, discard, materialize, quoted, slices

#: Words of a window and of a gram; rows of a minimizer beyond which its windows are dealt singly.
WINDOW, GRAM, FREQUENT = 35, 8, 2000
#: Words that a shard aims at, and words whose hashes a worker remembers.
SHARD_WORDS, REMEMBERED = 400_000, 150_000
#: Words of context by which suffixes are sorted; no longer match is followed at once.
CONTEXT = 64


# --- minimizers -------------------------------------------------------------------------------------

_hashes: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    known = _hashes
    if len(known) > REMEMBERED:
        known.clear()
    out = [known.get(w) for w in words]
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                out[i] = known[words[i]] = xxh64_intdigest(words[i])
    return np.array(out, dtype=np.uint64)


def minimizer_runs(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, last window) of each run of windows with one minimizer in one place."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    h = word_hashes(words)
    n = len(h) - gram + 1
    g = np.zeros(n, dtype=np.uint64)
    for j in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    # at: the leftmost place of each window's least gram. Equal windows have it at the same offset, so
    # that two of them are never in one run.
    at, span, grams = np.arange(n), 1, window - gram + 1

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(g[b] < g[a], b, a)

    while span * 2 <= grams:
        at, span = least(at[:-span], at[span:]), span * 2
    if rest := grams - span:
        at = least(at[:-rest], at[rest:])
    edges = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate([[0], edges])
    last = np.concatenate([edges - 1, [len(at) - 1]])
    return g[at[first]].view(np.int64), first.astype(np.int32), last.astype(np.int32)


# --- the index --------------------------------------------------------------------------------------


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class FMIndex:
    """Backward search over the texts put into it, given as one array of symbols from 1, 0 between texts."""

    def __init__(self, text: np.ndarray, context: int = CONTEXT):
        n = len(text)
        self.n, self.context = n, context
        rank = text.astype(np.int64)
        span = 1
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[: n - span] = rank[span:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + after
            order = np.argsort(key)
            sorted_key = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])]) if n else []
            span *= 2
            if span >= context or n and rank[order[-1]] == n - 1:
                break
        bwt = text[order - 1].astype(np.int64)  # the text before the first is the last's end
        size = int(text.max(initial=0)) + 1
        counts = np.bincount(text, minlength=size)
        smaller = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.levels: list[tuple[int, Bits, int]] = []
        symbols, starts = np.arange(size), np.zeros(size, dtype=np.int64)
        for shift in range(max(1, size - 1).bit_length() - 1, -1, -1):
            ones = (bwt >> shift) & 1
            bits = Bits(ones.astype(np.uint8))
            zeros = int(n - ones.sum())
            self.levels.append((shift, bits, zeros))
            r = bits.rank(starts)
            starts = np.where((symbols >> shift) & 1, zeros + r, starts - r)
            bwt = np.concatenate([bwt[ones == 0], bwt[ones == 1]])
        self.offset = smaller - starts

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of symbol + pattern from those of pattern."""
        both = np.concatenate([low, high])
        twice = np.concatenate([symbol, symbol])
        for shift, bits, zeros in self.levels:
            r = bits.rank(both)
            both = np.where((twice >> shift) & 1, zeros + r, both - r)
        both = both + self.offset[twice]
        return both[: len(low)], both[len(low) :]


def repeated(texts: list[np.ndarray], window: int, context: int = CONTEXT) -> list[list[tuple[int, int]]]:
    """For each text (symbols from 1), the intervals covered by windows that occur twice in the texts."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not texts:
        return found
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    whole = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
    for at, t in zip(starts.tolist(), texts, strict=True):
        whole[at : at + len(t)] = t
    index = FMIndex(whole, max(context, window))
    live = np.flatnonzero(lengths >= window)
    end = lengths[live].copy()
    left, low, high = end.copy(), np.zeros(len(live), np.int64), np.full(len(live), index.n, np.int64)
    while len(live):
        # One step to the left wherever the text and the sorted context allow it.
        can = (left > 0) & (end - left < index.context)
        symbol = whole[starts[live] + np.maximum(left, 1) - 1]
        new_low, new_high = index.extend(symbol, low, high)
        go = can & (new_high - new_low >= 2)
        left = np.where(go, left - 1, left)
        low, high = np.where(go, new_low, low), np.where(go, new_high, high)
        stop = ~go
        if stop.any():
            for i in np.flatnonzero(stop & (end - left >= window)).tolist():
                found[live[i]].append((int(left[i]), int(end[i])))
            # The next window to the right of which all is known starts one word further left.
            after = np.minimum(end - 1, left + window - 1)
            over = stop & ((left == 0) | (after < window))
            end = np.where(stop, after, end)
            left = np.where(stop, after, left)
            low, high = np.where(stop, 0, low), np.where(stop, index.n, high)
            if over.any():
                keep = ~over
                live, end, left, low, high = live[keep], end[keep], left[keep], low[keep], high[keep]
    return found


# --- the operator -----------------------------------------------------------------------------------


def _keyed(df: DataFrame, doc: str, text: str) -> DataFrame:
    """doc and text with (k1, k2), which rows of the same id and text, and so the same result, share; and
    the whole row as a struct."""
    k1, k2 = F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.xxhash64(F.col(doc), F.length(text))
    return df.select(F.col(doc).alias("doc"), F.col(text).alias("text"), k1.alias("k1"), k2.alias("k2"), F.struct(*quoted(df.columns)).alias("row"))


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _light(keyed: DataFrame) -> DataFrame:
    """doc, k1, k2, n_words and the digest of all words."""
    schema = T.StructType([keyed.schema["doc"], *(T.StructField(c, T.LongType()) for c in ("k1", "k2", "n_words")), T.StructField("sha", T.StringType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [_words(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), batch.column("k1"), batch.column("k2"), pa.array([len(w) for w in words], pa.int64()), pa.array([_sha(w) for w in words])], schema=out)

    return keyed.select("doc", "k1", "k2", "text").mapInArrow(run, schema)


def _runs(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    names = ["h", "k1", "k2", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("fmindex", _hashes.clear)
        for batch in slices(batches):
            parts = [minimizer_runs(_words(t), window, gram) for t in batch.column("text").to_pylist()]
            n = [len(p[0]) for p in parts]
            if sum(n):
                h, first, last = (np.concatenate([p[k] for p in parts]) for k in range(3))
                k1, k2 = (np.repeat(batch.column(c).to_numpy(), n) for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, k1, k2, first, last)], names=names)

    return keyed.select("k1", "k2", "text").mapInArrow(run, "h long, k1 long, k2 long, first int, last int")


def _stretches(candidates: DataFrame, shards: int, window: int) -> DataFrame:
    """The stretches of each candidate text, dealt to shards: shard, stretch, weight, k1, k2, at."""
    from xxhash import xxh64_intdigest

    names = ["shard", "stretch", "weight", "k1", "k2", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in names]

        def finish() -> pa.RecordBatch:
            nonlocal rows
            out = pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=names)
            rows = [[] for _ in names]
            return out

        for batch in slices(batches, 64):
            for k1, k2, weight, text, runs in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "weight", "text", "runs")), strict=True):
                words = _words(text)
                for r in runs:
                    if r["frequent"]:
                        cuts = [(x, x + window) for x in range(r["first"], r["last"] + 1)]
                    else:
                        cuts = [(r["first"], r["last"] + window)]
                    for a, b in cuts:
                        stretch = b" ".join(words[a:b]).decode()
                        shard = (xxh64_intdigest(stretch) if r["frequent"] else r["h"] * 0x9E3779B97F4A7C15 >> 20) % shards
                        for column, value in zip(rows, (shard, stretch, weight, k1, k2, a), strict=True):
                            column.append(value)
                if len(rows[0]) >= 4096:
                    yield finish()
        if rows[0]:
            yield finish()

    return candidates.mapInArrow(run, "shard int, stretch string, weight long, k1 long, k2 long, at int")


def _search(window: int):
    def run(group: pa.Table) -> pa.Table:
        stretches, weights = group.column("stretch").to_pylist(), group.column("weight").to_numpy()
        numbers: dict[str, int] = {}
        texts = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in s.split(" ")], dtype=np.int64) for s in stretches]
        found = repeated(texts, window)
        rows = [(i, a, b) for i, t in enumerate(texts) for a, b in ([(0, len(t))] if weights[i] > 1 else found[i])]
        take = pa.array([r[0] for r in rows], pa.int64())
        return pa.table({"s1": group.column("s1").take(take), "s2": group.column("s2").take(take), "a": pa.array([r[1] for r in rows], pa.int32()), "b": pa.array([r[2] for r in rows], pa.int32())})

    return run


def find(df: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(rows, changed): every row's doc, k1, k2, n_words, sha and whether its text has copies; and for
    each text without copies that loses words its k1, k2, kept text, digest and number of words lost."""
    keyed = _keyed(df, doc, text)
    light = materialize(_light(keyed))
    # Texts are copies if the digest of all their words agrees.
    copies = materialize(light.groupBy("sha").agg(F.min(F.struct("k1", "k2")).alias("one"), F.count(F.lit(1)).alias("copies")).select("sha", "one.k1", "one.k2", "copies"))
    runs = materialize(_runs(keyed, window, gram))
    # Written, so that both sides of the join are plain shuffles, whose skewed partitions Spark splits.
    often = materialize(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", (F.col("n") > frequent).alias("frequent")))
    stays = runs.hint("merge").join(often.hint("merge"), "h")
    one = copies.select("k1", "k2", F.least("copies", F.lit(2).cast("long")).alias("weight"))
    wanted = stays.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last", "h", "frequent")).alias("runs"))
    wanted = materialize(wanted.join(one, ["k1", "k2"]))
    discard(runs, often)
    candidates = materialize(keyed.select("k1", "k2", "text").hint("merge").join(wanted.hint("merge"), ["k1", "k2"]))
    words = candidates.select(F.explode("runs").alias("r")).agg(F.sum(F.col("r.last") - F.col("r.first") + window)).first()[0] or 0
    stretches = materialize(_stretches(candidates, max(1, -(-words // shard_words)), window))
    marks = [F.xxhash64("stretch").alias("s1"), F.xxhash64("stretch", F.lit(1)).alias("s2")]
    distinct = stretches.groupBy("shard", "stretch").agg(F.sum("weight").alias("weight")).select("shard", "stretch", "weight", *marks)
    hits = distinct.groupBy("shard").applyInArrow(_search(window), "s1 long, s2 long, a int, b int")
    places = stretches.filter("weight = 1").select(*marks, "k1", "k2", "at")
    ranges = places.hint("merge").join(hits.hint("merge"), ["s1", "s2"]).groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))).alias("ranges"))
    changed = candidates.select("k1", "k2", "text").dropDuplicates(["k1", "k2"]).hint("merge").join(ranges.hint("merge"), ["k1", "k2"]).mapInArrow(_cut, "k1 long, k2 long, kept string, sha string, lost long")
    changed = materialize(changed)
    discard(wanted, candidates, stretches)
    has = copies.select("sha", F.col("copies").alias("_n"))
    return light.hint("merge").join(has.hint("merge"), "sha").withColumn("copied", (F.col("_n") > 1) & (F.col("n_words") >= window)).drop("_n"), changed


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows: list[tuple[str, str, int]] = []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            words = _words(text)
            keep = np.ones(len(words), dtype=bool)
            for r in ranges:
                keep[r["a"] : r["b"]] = False
            kept = [words[i] for i in np.flatnonzero(keep)]
            rows.append((b" ".join(kept).decode(), _sha(kept), len(words) - len(kept)))
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["k1", "k2", "kept", "sha", "lost"])


def _settled(found: tuple[DataFrame, DataFrame], *more: str) -> DataFrame:
    rows, changed = found
    changed = changed.select("k1", "k2", F.col("sha").alias("_sha"), "lost", *more)
    return rows.join(changed, ["k1", "k2"], "left")


def _lost() -> Column:
    return F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("lost", F.lit(0).cast("long")))


def digests(df: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, **settings: int) -> DataFrame:
    """doc, n_words, n_removed and the digest of the kept words of every row."""
    rows = _settled(find(df, doc, text, window, **settings))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(F.col("doc").alias(doc), "n_words", _lost().alias("n_removed"), F.when(F.col("copied"), nothing).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"))


def remove_repeats(df: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, **settings: int) -> DataFrame:
    """df with the words that repeated windows cover removed from its text. A text that loses words has
    the rest joined by single spaces; others stay as they are."""
    rows = _settled(find(df, doc, text, window, **settings), "kept").filter("copied or lost > 0").select("k1", "k2", "copied", "kept").dropDuplicates(["k1", "k2"])
    new = F.when(F.col("copied"), F.lit("")).otherwise(F.coalesce(F.col("kept"), F.col("row").getField(text)))
    found = _keyed(df, doc, text).select("row", "k1", "k2").hint("merge").join(rows.hint("merge"), ["k1", "k2"], "left")
    return found.select(*[new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns])
