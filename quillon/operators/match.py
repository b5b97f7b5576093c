"""Full-text queries written as text, as one predicate over a row's own tokens.

Terms, "phrases", a + b, prefix*, ^first, NEAR(a b, n), {columns}: and -column: filters, implicit AND, NOT,
AND, OR (in that order of strength) and parentheses. The predicate reads the token arrays of one row, so that
a search is a scan without a shuffle; every text is cut into tokens once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import words

DISTANCE = 10
_LEXEME = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([^\W]+)|([-+*^:(){},]))')


class QueryError(ValueError):
    """A text that is no query."""


@dataclass
class Phrase:
    """Terms one after another; prefix: the last is a beginning; first: at the column's start."""

    terms: list[str]
    prefix: bool = False
    first: bool = False

    def places(self, tokens: Column) -> Column:
        """The places at which the phrase begins."""
        n = len(self.terms)
        if not n:
            return F.array().cast("array<int>")

        def at(i: Column) -> Column:
            tests = [F.get(tokens, i + j) == t for j, t in enumerate(self.terms)]
            if self.prefix:
                tests[-1] = F.get(tokens, i + (n - 1)).startswith(self.terms[-1])
            return reduce(lambda a, b: a & b, tests)

        last = F.lit(0) if self.first else F.size(tokens) - n
        return F.when(F.size(tokens) >= n, F.filter(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<int>"))


def _numbered(places: Column, k: int) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(k).alias("k")))


@dataclass
class Near:
    """Phrases of one column with at most distance tokens from the first one's end to the last one's start."""

    phrases: list[Phrase]
    distance: int = DISTANCE

    def holds(self, tokens: Column) -> Column:
        if len(self.phrases) == 1:
            return F.size(self.phrases[0].places(tokens)) > 0
        none, lengths = F.lit(-1), F.array(*[F.lit(len(p.terms)) for p in self.phrases])
        starts = [_numbered(p.places(tokens), k) for k, p in enumerate(self.phrases)]
        # One walk over the starts in order; the state is the latest start of each phrase.
        first = F.struct(F.array(*[none] * len(self.phrases)).alias("last"), F.lit(False).alias("hit"))

        def step(state: Column, start: Column) -> Column:
            last = F.transform(state["last"], lambda x, k: F.when(k == start["k"], start["at"]).otherwise(x))
            least = F.array_min(F.transform(last, lambda x, k: F.struct(x.alias("at"), (-F.get(lengths, k)).alias("length"))))
            hit = (least["at"] >= 0) & (start["at"] - (least["at"] - least["length"]) <= self.distance)
            return F.struct(last.alias("last"), (state["hit"] | hit).alias("hit"))

        return F.aggregate(F.array_sort(F.concat(*starts)), first, step, lambda s: s["hit"])


#: A parsed query: from (columns' tokens) to a condition.
Node = Callable[[Mapping[str, Column]], Column]


class _Parser:
    def __init__(self, text: str, columns: list[str]):
        self.columns, self.at, self.lexemes = columns, 0, []
        place = 0
        while text[place:].strip():
            found = _LEXEME.match(text, place)
            if not found:
                raise QueryError(f"no query at {text[place:]!r}")
            kind = "string" if found[1] is not None else "word" if found[2] else found[3]
            self.lexemes.append((kind, found[1].replace('""', '"') if found[1] is not None else found[2] or found[3]))
            place = found.end()

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.lexemes[self.at + ahead] if self.at + ahead < len(self.lexemes) else ("end", "")

    def take(self, kind: str) -> str:
        found, text = self.peek()
        if found != kind:
            raise QueryError(f"{kind!r} expected, {text or 'end'!r} found")
        self.at += 1
        return text

    def whole(self) -> Node:
        node = self.any_of(self.columns)
        if self.peek()[0] != "end":
            raise QueryError(f"{self.peek()[1]!r} is not expected")
        return node

    def _chain(self, word: str, part: Callable[[list[str]], Node], join: Callable[[Column, Column], Column], allowed: list[str]) -> Node:
        node = part(allowed)
        while self.peek() == ("word", word):
            self.at += 1
            node = (lambda a, b: lambda row: join(a(row), b(row)))(node, part(allowed))
        return node

    def any_of(self, allowed: list[str]) -> Node:
        return self._chain("OR", self.all_of, lambda a, b: a | b, allowed)

    def all_of(self, allowed: list[str]) -> Node:
        return self._chain("AND", self.without, lambda a, b: a & b, allowed)

    def without(self, allowed: list[str]) -> Node:
        return self._chain("NOT", self.side_by_side, lambda a, b: a & ~b, allowed)

    def side_by_side(self, allowed: list[str]) -> Node:
        nodes = [self.one(allowed)]
        while self.peek()[0] in ("string", "word", "^", "(", "{", "-") and self.peek()[1] not in ("AND", "OR", "NOT"):
            nodes.append(self.one(allowed))
        return lambda row: reduce(lambda a, b: a & b, [n(row) for n in nodes])

    def one(self, allowed: list[str]) -> Node:
        kind, text = self.peek()
        if kind in ("{", "-") or kind in ("word", "string") and self.peek(1)[0] == ":":
            chosen = self.column_filter()
            return self.one([c for c in allowed if c.lower() in chosen])
        if kind == "(":
            self.at += 1
            node = self.any_of(allowed)
            self.take(")")
            return node
        near = self.near() if (kind, text) == ("word", "NEAR") and self.peek(1)[0] == "(" else Near([self.phrase()])
        near.phrases = [p for p in near.phrases if p.terms]
        if not near.phrases or not allowed:
            return lambda row: F.lit(False)
        return lambda row: reduce(lambda a, b: a | b, [near.holds(row[c]) for c in allowed])

    def column_filter(self) -> set[str]:
        inverse, names = self.peek()[0] == "-", []
        self.at += inverse
        if self.peek()[0] == "{":
            self.at += 1
            while self.peek()[0] != "}":
                names.append(self.take(self.peek()[0] if self.peek()[0] in ("word", "string") else "word"))
            self.at += 1
        else:
            names.append(self.take("string" if self.peek()[0] == "string" else "word"))
        self.take(":")
        known, chosen = {c.lower() for c in self.columns}, {n.lower() for n in names}
        if chosen - known:
            raise QueryError(f"no column {sorted(chosen - known)}")
        return known - chosen if inverse else chosen

    def near(self) -> Near:
        self.at += 2
        found = Near([self.phrase()])
        while self.peek()[0] in ("string", "word", "^"):
            found.phrases.append(self.phrase())
        if self.peek()[0] == ",":
            self.at += 1
            number = self.take("word")
            if not number.isdigit():
                raise QueryError(f"{number!r} is no distance")
            found.distance = int(number)
        self.take(")")
        return found

    def phrase(self) -> Phrase:
        found = Phrase([])
        if self.peek()[0] == "^":
            self.at += 1
            found.first = True
        while True:
            kind, text = self.peek()
            if kind not in ("string", "word") or kind == "word" and text in ("AND", "OR", "NOT"):
                raise QueryError(f"a term expected, {text or 'end'!r} found")
            self.at += 1
            found.terms += re.findall(r"[^\W_]+", text.lower())
            if self.peek()[0] != "+":
                break
            self.at += 1
        if self.peek()[0] == "*":
            self.at += 1
            found.prefix = True
        return found


def matches(columns: Mapping[str, Column], query: str, tokenizer: Callable[[Column], Column] = words) -> Column:
    """Whether a row's texts, by column name, match a query. A null text has no tokens."""
    node = _Parser(query, list(columns)).whole()
    none = F.array().cast("array<string>")
    row = F.struct(*[F.coalesce(tokenizer(text), none).alias(name) for name, text in columns.items()])
    # As a lambda's argument the tokens are made once, however often the predicate reads them.
    return F.exists(F.array(row), lambda r: node({name: r[name] for name in columns}))


def match(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """The rows of df whose columns match a query."""
    return df.filter(matches({c: F.col(c) for c in columns}, query))
