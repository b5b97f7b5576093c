"""Full-text search over a token-position table.

tokens() makes one row for each token; queries are predicates over positions: a phrase is a chain of
positions, NEAR a range of them, a prefix a range of terms. Terms of a query are few, so that they filter
the token table before anything is shuffled. bm25 ranks with k1 = 1.2 and b = 0.75; smaller is better.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(F.lower(text), i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def tokens(df: DataFrame, key: str, text: str, tokenizer=words) -> DataFrame:
    """(key, pos, term), positions from 0."""
    return df.select(key, F.posexplode(tokenizer(F.col(text))).alias("pos", "term"))


def having(table: DataFrame, key: str, term: str, prefix: bool = False, first: bool = False) -> DataFrame:
    """Keys of the rows with a term (or a term that begins so), possibly as the first token."""
    hit = F.col("term").startswith(term) if prefix else F.col("term") == term
    return table.filter(hit & (F.col("pos") == 0) if first else hit).select(key).distinct()


def all_of(sets: Sequence[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "left_semi"), sets)


def any_of(sets: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.union(b), sets).distinct()


def without(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "left_anti")


def phrase(table: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """Keys of the rows with the terms one after another: each start has all of its offsets."""
    offset = F.create_map(*[x for i, t in enumerate(dict.fromkeys(terms)) for x in (F.lit(t), F.array(*[F.lit(j) for j, u in enumerate(terms) if u == t]))])
    starts = table.filter(F.col("term").isin(*terms)).select(key, F.explode(F.transform(offset[F.col("term")], lambda j: F.struct((F.col("pos") - j).alias("start"), j.alias("j")))).alias("s"))
    return starts.groupBy(key, "s.start").agg(F.count_distinct("s.j").alias("n")).filter(F.col("n") == len(terms)).select(key).distinct()


def near(table: DataFrame, key: str, a: str, b: str, distance: int = 10) -> DataFrame:
    """Keys of the rows in which at most distance tokens stand between the two terms."""
    own = table.filter(F.col("term").isin(a, b)).select(key, "pos", "term")
    # One pass over the terms' places: each is held against the last one of the other term.
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    of = lambda t: F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(before)
    last = of(a) if a == b else F.when(F.col("term") == a, of(b)).otherwise(of(a))
    return own.withColumn("_last", last).filter(F.col("pos") - F.col("_last") <= distance + 1).select(key).distinct()


def _times(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def bm25(df: DataFrame, key: str, text: str, terms: Sequence[str], tokenizer=words) -> DataFrame:
    """(key, rank) of the rows with any of the terms; key is unique. Each row counts its own terms, so that
    no token is shuffled; the statistics of all rows are one row."""
    empty = F.array().cast("array<string>")
    counted = F.transform(
        F.array(F.coalesce(tokenizer(F.col(text)), empty)),
        lambda w: F.struct(F.size(w).alias("len"), *[_times(w, t).alias(f"tf{i}") for i, t in enumerate(terms)]),
    )
    rows = df.select(key, F.explode(counted).alias("s")).select(key, "s.*")
    has = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]
    full = rows.filter("len > 0")
    totals = full.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"), *has)
    parts = []
    for i in range(len(terms)):
        tf, n = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("docs") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        parts.append(F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))).otherwise(0.0))
    any_term = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    return full.filter(any_term).join(F.broadcast(totals)).select(key, (-reduce(lambda a, b: a + b, parts)).alias("rank"))


def vocabulary(table: DataFrame, key: str) -> DataFrame:
    """(term, doc, cnt): rows and occurrences of every term."""
    return table.groupBy("term").agg(F.count_distinct(key).alias("doc"), F.count(F.lit(1)).alias("cnt"))


def highlight(text: Column, terms: Sequence[str], open_: str, close: str) -> Column:
    """The text with its terms between marks."""
    import re

    pattern = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(re.escape(t) for t in terms) + r")(?![\p{L}\p{N}])"
    return F.regexp_replace(text, pattern, re.sub(r"([\\$])", r"\\\1", open_) + "$1" + re.sub(r"([\\$])", r"\\\1", close))


def snippet(text: Column, terms: Sequence[str], open_: str = "[", close: str = "]", ellipsis: str = "...", size: int = 15) -> Column:
    """size words of the text around its first term, highlighted."""
    parts = F.split(text, r"\s+")
    bare = F.transform(parts, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    place = F.array_min(F.filter(F.array(*[F.array_position(bare, t) for t in terms]), lambda p: p > 0))
    start = F.greatest(F.lit(1), F.least(place - size // 2, F.size(parts) - size + 1)).cast("int")
    body = highlight(F.array_join(F.slice(parts, start, size), " "), terms, open_, close)
    return F.when(place.isNotNull(), F.concat(F.when(start > 1, ellipsis).otherwise(""), body, F.when(start + size <= F.size(parts), ellipsis).otherwise("")))
