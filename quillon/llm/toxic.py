"""Toxicity by a learned lexicon that Levenshtein automata read, with context windows.

A bounded sample of labelled rows yields terms (whole words and word stems) that toxic texts hold and
clean ones don't, by log-likelihood ratio. The terms form a trie; its intersection with the Levenshtein
automata of all terms (substitution, insertion, deletion, transposition) is made deterministic as words
are read, so that a word costs a dictionary step per character until no term is near. A misspelled
term's weight is what the sample says of it; unseen ones weigh three quarters. The words around a hit tell
quotation (quote marks, reporting words) from abuse (address in the second person). A logistic model
over the evidence gives the score.

Defined results: null and empty texts score like a text without hits, long ones are read whole; without
labelled rows of both classes every score is 0; a null id counts as held out; ids that occur twice in the
labels take the larger label, those with several texts the least of these; of terms that are equally near a
word the first in order counts; repeated rows are scored once each; an empty table gives no rows. Other
columns, whatever their names, are ignored, or kept by score().
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, claim, discard, fresh, materialize, quoted, slices

#: Labelled rows of each class from which the model is learned.
TRAINING_ROWS = 3000
#: A term's least log-likelihood ratio (or twice the log of the candidates' number, if that is more) and
#: log odds; shortest and longest stems; words that a stem begins.
RATIO, ODDS, STEM, BRANCHES = 12.0, 2.5, (3, 8), 3
#: Words on each side of a hit that tell its context; states and words that a worker remembers.
WINDOW, STATES, WORDS = 8, 100_000, 200_000
# Marks that surround words, marks of quotation, reporting words, address.
EDGES = ".,;:!?%*#$&|()[]{}<>\"'`~_-+=/\\“”„«»‘’…"
OPEN, CLOSE, EVEN = "“„«", "”»", '"'
REPORTING = frozenset("said says quote quoted quotes quoting wrote called word term slur according reported cited sagte schrieb zitat dit écrit cite dijo escribió cita".split())
ADDRESS = frozenset("you your you're u ur yourself du dich dein tu toi ton te tú ti usted".split())


def allowed(term: str) -> int:
    """Edits at which a word still counts as a misspelling of a term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms in a trie, read by the lazily determinised union of their Levenshtein automata."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], fuzzy: dict[str, float]):
        self.words, self.stems, self.fuzzy = words, stems, fuzzy
        self.children: list[dict[str, int]] = [{}]
        self.limit, self.word, self.stem = [0], [""], [""]
        for term, is_stem in [(w, False) for w in words] + [(s, True) for s in stems]:
            at, most = 0, 0 if is_stem else allowed(term)
            self.limit[0] = max(self.limit[0], most)
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                    self.word.append("")
                    self.stem.append("")
                at = self.children[at][c]
                self.limit[at] = max(self.limit[at], most)
            if is_stem:
                self.stem[at] = term
            else:
                self.word[at] = term
        self.clear()
        self.known: dict[str, tuple[str, str] | None] = {}

    def clear(self) -> None:
        self.sets: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[str, str] | None] = []
        self.start = self._state({(0, 0, 0, "")})

    def _state(self, items: set) -> int:
        """The number of a set of (node, edits, target, awaited): target and awaited of a transposition,
        or node -1 and the stem that has been read."""
        stack, closed = list(items), set()
        while stack:
            item = stack.pop()
            if item in closed:
                continue
            closed.add(item)
            node, edits, _, awaited = item
            if node >= 0 and not awaited and edits < self.limit[node]:
                stack += [(child, edits + 1, 0, "") for child in self.children[node].values() if edits < self.limit[child]]
        key = frozenset(closed)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            stem = next((a for n, _, _, a in sorted(key) if n == -1), None)
            whole = sorted((e, self.word[n]) for n, e, _, a in key if n >= 0 and not a and self.word[n] and e <= allowed(self.word[n]))
            self.accepts.append(("word" if whole[0][0] == 0 else "fuzzy", whole[0][1]) if whole and (whole[0][0] == 0 or not stem) else ("stem", stem) if stem else None)
        return self.numbers[key]

    def _step(self, number: int, c: str) -> int:
        found = set()
        for node, edits, target, awaited in self.sets[number]:
            if node == -1:
                found.add((node, edits, target, awaited))
                continue
            if awaited:
                if c == awaited:
                    found.add((target, edits, 0, ""))
                continue
            child = self.children[node].get(c)
            if child is not None:
                found.add((child, edits, 0, ""))
                if edits == 0 and self.stem[child]:
                    found.add((-1, 0, 0, self.stem[child]))
            if edits < self.limit[node]:
                found.add((node, edits + 1, 0, ""))
                for other, at in self.children[node].items():
                    if edits < self.limit[at]:
                        if other != c:
                            found.add((at, edits + 1, 0, ""))
                        after = self.children[at].get(c)
                        if other != c and after is not None and edits < self.limit[after]:
                            found.add((node, edits + 1, after, other))
        if len(self.sets) > STATES:
            self.clear()
            return self._state(found) if found else -1
        to = self._state(found) if found else -1
        self.steps[number][c] = to
        return to

    def match(self, token: str) -> tuple[str, str] | None:
        """(kind, term) of the term that a token is or misspells: kind word, stem or fuzzy."""
        if token in self.known:
            return self.known[token]
        word, at = token.strip(EDGES), self.start
        for c in word:
            to = self.steps[at].get(c)
            at = self._step(at, c) if to is None else to
            if at < 0:
                break
        found = self.accepts[at] if at >= 0 and word else None
        if len(self.known) >= WORDS:
            self.known.clear()
        self.known[token] = found
        return found

    def weight(self, kind: str, term: str) -> float:
        return self.words[term] if kind == "word" else self.stems[term] if kind == "stem" else self.fuzzy.get(term, self.words[term] * 0.75)

    def hits(self, tokens: list[str]) -> list[tuple[int, str, str]]:
        known, match = self.known, self.match
        return [(i, *got) for i, t in enumerate(tokens) if (got := known[t] if t in known else match(t))]


def context(tokens: list[str], at: int) -> float:
    """What a hit counts in its window: less when quoted or reported, more when it addresses someone."""
    before, after = tokens[max(0, at - WINDOW) : at + 1], tokens[at : at + WINDOW + 1]
    left, right = " ".join(before[:-1]) + " " + before[-1][: len(before[-1]) // 2], after[0][len(after[0]) // 2 :] + " " + " ".join(after[1:])
    opened = max(left.rfind(c) for c in OPEN) > max(left.rfind(c) for c in CLOSE) or left.count(EVEN) % 2 == 1
    quoted = opened and any(c in right for c in CLOSE + EVEN)
    words = {t.strip(EDGES) for t in before + after}
    return (0.3 if quoted else 1.0) * (0.6 if words & REPORTING else 1.0) * (1.2 if words & ADDRESS and not quoted else 1.0)


def evidence(text: str | None, lexicon: Lexicon) -> tuple[float, float, float]:
    """(strongest hit, log of the sum, log of the text's length)."""
    tokens = text.lower().split() if text else []
    values = [w * context(tokens, i) for i, kind, term in lexicon.hits(tokens) if (w := lexicon.weight(kind, term)) > 0]
    return max(values, default=0.0), math.log1p(sum(values)), math.log1p(len(tokens))


def _odds(t: int, c: int, nt: int, nc: int) -> float:
    return math.log((t + 0.5) / (nt + 1)) - math.log((c + 0.5) / (nc + 1))


def _telling(nt: int, nc: int) -> tuple[Column, Column]:
    """(log odds, log-likelihood ratio) of a term that t of nt toxic and c of nc clean texts hold."""
    t, c, one = F.col("t").cast("double"), F.col("c").cast("double"), F.lit(1.0)

    def part(k: Column, n: int, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (F.lit(float(n)) - k) * F.log(one - p)).otherwise(0.0)

    p = (t + c) / float(nt + nc)
    ratio = (part(t, nt, t / nt) + part(c, nc, c / nc) - part(t, nt, p) - part(c, nc, p)) * 2
    odds = F.log((t + 0.5) / (nt + 1.0)) - F.log((c + 0.5) / (nc + 1.0))
    return odds, F.when(p < 1, ratio).otherwise(0.0)


class Model:
    """Lexicon weights and the logistic model; small enough to travel with the tasks."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], fuzzy: dict[str, float], coefficients: list[float] | None):
        self.parts, self.coefficients = (words, stems, fuzzy), coefficients
        self._lexicon: Lexicon | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lexicon": None}

    @property
    def lexicon(self) -> Lexicon:
        self._lexicon = self._lexicon or Lexicon(*self.parts)
        return self._lexicon

    def score(self, text: str | None) -> float:
        if self.coefficients is None:
            return 0.0
        x = sum(a * b for a, b in zip(self.coefficients, (1.0, *evidence(text, self.lexicon)), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def vocabulary(text: str | None) -> set[str]:
    return {w for t in set(text.lower().split()) if (w := t.strip(EDGES))} if text else set()


def _stems(words: Iterable[str]) -> set[str]:
    return {w[:k] for w in words for k in range(STEM[0], STEM[1] + 1) if len(w) > k}


def term_counts(sample: DataFrame) -> DataFrame:
    """stem (whether), term, t and c: the toxic and clean texts that hold a word or a stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = vocabulary(text)
                counts[label].update((False, w) for w in words)
                counts[label].update((True, s) for s in _stems(words))
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["stem", "term", "t", "c"])

    found = sample.mapInArrow(run, "stem boolean, term string, t long, c long")
    return found.groupBy("stem", "term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _chosen(counts: DataFrame, nt: int, nc: int) -> tuple[dict[str, tuple[int, float]], dict[str, tuple[int, float]]]:
    """(words, stems) that tell toxic texts, with their toxic texts and log odds. How many there can be
    follows from the least ratio and odds, not from the size of the texts' vocabulary."""
    often = {r["stem"]: r["count"] for r in counts.filter("t >= 3").groupBy("stem").count().collect()}
    odds, ratio = _telling(nt, nc)
    found: tuple[dict, dict] = ({}, {})
    for stem in (False, True):
        least = max(RATIO, 2 * math.log(often.get(stem, 0) + 1))
        told = counts.filter((F.col("stem") == stem) & (F.col("t") >= 3) & (F.col("t") * nc > F.col("c") * nt) & (odds >= ODDS) & (ratio >= least))
        for r in told.select("term", "t", "c").collect():
            found[stem][r["term"]] = (r["t"], _odds(r["t"], r["c"], nt, nc))
    return found


def _settle(words: dict[str, tuple[int, float]], stems: dict[str, tuple[int, float]], branches: dict[str, int]) -> tuple[dict[str, float], dict[str, float]]:
    """The terms that stay, with their log odds."""
    stems = {s: x for s, x in stems.items() if branches.get(s, 0) >= BRANCHES}
    # Of stems that stand for the same texts the longest, and none that a shorter one makes needless.
    longer: dict[str, int] = {}
    for q, (n, _) in stems.items():
        longer[q[:-1]] = max(n, longer.get(q[:-1], 0))
    kept: dict[str, tuple[int, float]] = {}
    for s in sorted(stems, key=lambda s: (len(s), s)):
        n, odds = stems[s]
        if longer.get(s, 0) >= 0.98 * n:
            continue
        if not any(p in kept and kept[p][1] >= odds - 0.5 for p in (s[:k] for k in range(STEM[0], len(s)))):
            kept[s] = (n, odds)
    words = {w: x for w, x in words.items() if not any(p in kept and kept[p][1] >= x[1] - 0.5 for p in (w[:k] for k in range(STEM[0], len(w))))}
    return {w: words[w][1] for w in sorted(words)}, {s: kept[s][1] for s in sorted(kept)}


def _fuzzy_counts(sample: DataFrame, words: dict[str, float], stems: dict[str, float]) -> DataFrame:
    """term, t and c: the toxic and clean texts that hold a misspelling of a term."""
    model = Model(words, stems, {}, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxic", lambda: None)
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                counts[label].update({got[1] for w in vocabulary(text) if (got := model.lexicon.match(w)) and got[0] == "fuzzy"})
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][x] for x in terms], pa.int64()), pa.array([counts[0][x] for x in terms], pa.int64())], names=["term", "t", "c"])

    return sample.mapInArrow(run, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _evidence_rows(sample: DataFrame, words: dict[str, float], stems: dict[str, float], fuzzy: dict[str, float]) -> DataFrame:
    model = Model(words, stems, fuzzy, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxic", lambda: None)
        for batch in slices(batches):
            x = [evidence(t, model.lexicon) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in x], pa.float64()) for k in range(3)] + [batch.column("label")], names=["a", "b", "c", "label"])

    return sample.mapInArrow(run, "a double, b double, c double, label int")


def learn(sample: DataFrame, prior: float | None = None) -> Model:
    """A model of rows of text and label, each counted once; prior is the share of label 1 where the rows were
    drawn. Texts stay with the executors: the driver gets the chosen terms and three numbers a text."""
    sample = materialize(sample.select(F.col("text").cast("string"), F.col("label").cast("int")).fillna("", ["text"]).distinct())
    nt, nc = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1)) - F.coalesce(F.sum("label"), F.lit(0))).first()
    if not nt or not nc:
        discard(sample)
        return Model({}, {}, {}, None)
    counts = materialize(term_counts(sample))
    words, stems = _chosen(counts, nt, nc)
    begun = counts.filter("not stem and t > 0").select("term", F.explode(F.sequence(F.lit(STEM[0]), F.lit(STEM[1]))).alias("k")).filter(F.length("term") > F.col("k")).select(F.substring("term", F.lit(1), F.col("k")).alias("stem"))
    branches = {r["stem"]: r["count"] for r in begun.filter(F.col("stem").isin(list(stems))).groupBy("stem").count().collect()} if stems else {}
    words, stems = _settle(words, stems, branches)
    seen = {r["term"]: (r["t"], r["c"]) for r in _fuzzy_counts(sample, words, stems).collect()}
    fuzzy = {w: min(words[w], _odds(*seen[w], nt, nc)) for w in words if w in seen}
    rows = np.array(sorted(tuple(r) for r in _evidence_rows(sample, words, stems, fuzzy).collect()))
    discard(sample, counts)
    x, y = np.concatenate([np.ones((len(rows), 1)), rows[:, :3]], axis=1), rows[:, 3]
    p = min(max(nt / (nt + nc) if prior is None else prior, 1e-3), 1 - 1e-3)
    w = np.where(y == 1, p * len(y) / nt, (1 - p) * len(y) / nc)
    b = np.zeros(4)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        penalty = np.array([0.0, 0.05, 0.05, 0.05]) * 2
        step = np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + np.diag(penalty + 1e-6), x.T @ (w * (y - q)) - penalty * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(words, stems, fuzzy, b.tolist())


def held_out(doc: Column) -> Column:
    """Whether a document's labels must not be learned from."""
    return F.pmod(F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Learn from at most rows labelled documents of each class, none of them held out. Of an id's texts the
    least is read."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    drawn = [known.filter(F.col("label") == label).orderBy(F.xxhash64("_id"), "_id").limit(rows) for label in (0, 1)]
    # At most 2 * rows ids are broadcast.
    texts = documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("text"))
    sample = texts.join(F.broadcast(drawn[0].union(drawn[1])), "_id").groupBy("_id", "label").agg(F.min("text").alias("text"))
    return learn(sample.select("text", "label"), share)


def score(documents: DataFrame, model: Model, keep: Iterable[str] = ("doc_id",), text: str = "text", result: str = "score") -> DataFrame:
    """The kept columns and the score, from 0 to 1, of every whole text."""
    keep, body = list(keep), fresh(documents, "_text")
    schema = T.StructType([documents.schema[c] for c in keep] + [T.StructField(result, T.DoubleType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxic", lambda: None)
        for batch in slices(batches):
            scores = [model.score(t) for t in batch.column(body).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(out.field(c).type) for c in keep] + [pa.array(scores, pa.float64())], schema=out)

    return documents.select(*quoted(keep), F.col(text).alias(body)).mapInArrow(run, schema)
