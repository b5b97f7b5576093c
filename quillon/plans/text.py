"""Queries for full-text search over the documents and the part names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extras as X
from ..functions import scalar as S
from ..operators import match as M
from ..operators import search as Q
from .registry import query
from .tables import table

# The same tokens in DuckDB.
_T = "SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents) d"
_WITH = f"WITH t AS ({_T}) "


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.tokens(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("fts_and_or_not", _WITH + "SELECT doc_id FROM t GROUP BY doc_id HAVING bool_or(term = 'the') AND (bool_or(term = 'scum') OR bool_or(term = 'license')) AND NOT bool_or(term = 'idiot')")
def fts_and_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir)
    has = lambda w: Q.having(t, "doc_id", w)
    return Q.without(Q.all_of([has("the"), Q.any_of([has("scum"), has("license")])], "doc_id"), has("idiot"), "doc_id")


@query("fts_phrase", _WITH + "SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN t c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'all' AND b.term = 'rights' AND c.term = 'reserved'")
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.phrase(_tokens(spark, sf_dir), "doc_id", ["all", "rights", "reserved"])


@query("fts_prefix", _WITH + "SELECT DISTINCT doc_id FROM t WHERE starts_with(term, 'licen')")
def fts_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.having(_tokens(spark, sf_dir), "doc_id", "licen", prefix=True)


@query("fts_first", _WITH + "SELECT DISTINCT doc_id FROM t WHERE pos = 0 AND term = 'the'")
def fts_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.having(_tokens(spark, sf_dir), "doc_id", "the", first=True)


@query("fts_near", _WITH + "SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 4 AND a.pos <> b.pos WHERE a.term = 'the' AND b.term = 'with'")
def fts_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.near(_tokens(spark, sf_dir), "doc_id", "the", "with", 3)


@query("fts_bm25", _WITH + """, l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY doc_id), s AS (SELECT count(*) AS docs, avg(len) AS mean FROM l),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ('scum', 'license') GROUP BY doc_id, term), d AS (SELECT term, count(*) AS df FROM f GROUP BY term)
SELECT doc_id, round(-sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS rank FROM f JOIN d USING (term) JOIN l USING (doc_id) CROSS JOIN s GROUP BY doc_id""")
def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["scum", "license"]).select("doc_id", F.round("rank", 6).alias("rank"))


@query("fts_vocabulary", _WITH + "SELECT term, count(DISTINCT doc_id) AS doc, count(*) AS cnt FROM t GROUP BY term")
def fts_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.vocabulary(_tokens(spark, sf_dir), "doc_id")


@query("fts_trigrams", "SELECT p_partkey, lower(substr(p_name, CAST(i AS INT), 3)) AS term FROM part, range(1, 200) r(i) WHERE i <= length(p_name) - 2")
def fts_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.tokens(table(spark, sf_dir, "part"), "p_partkey", "p_name", Q.trigrams).select("p_partkey", "term")


@query("fts_porter", "SELECT r_regionkey, 'relat' AS a, 'hope' AS b, 'caress' AS c, 'poni' AS d, 'gener' AS e FROM region")
def fts_porter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", *[X.porter(F.lit(w)).alias(n) for n, w in zip("abcde", ("relational", "hoping", "caresses", "ponies", "generalization"), strict=True)])


@query("fts_highlight", "SELECT doc_id, regexp_replace(text, '(?i)\\b(license)\\b', '[\\1]', 'g') AS h FROM documents WHERE regexp_matches(text, '(?i)\\blicense\\b')")
def fts_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"(?i)\blicense\b"))
    return docs.select("doc_id", Q.highlight(F.col("text"), ["license"], "[", "]").alias("h"))


@query("fts_snippet")
def fts_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", Q.snippet(F.col("text"), ["license", "scum"]).alias("s")).filter("s IS NOT NULL")


@query("next_char", "SELECT DISTINCT substr(p_name, 2, 1) AS c FROM part WHERE starts_with(p_name, 'b') AND length(p_name) > 1")
def next_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters that can follow a prefix."""
    part = table(spark, sf_dir, "part").filter(F.col("p_name").startswith("b") & (F.length("p_name") > 1))
    return part.select(F.substr("p_name", F.lit(2), F.lit(1)).alias("c")).distinct()


@query("prefixes", "SELECT n_nationkey, substr(n_name, 1, CAST(i AS INT)) AS prefix FROM nation, range(0, 50) r(i) WHERE i <= length(n_name)")
def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(S.prefixes(F.col("n_name"))).alias("prefix"))


@query("approximate_match", "SELECT p_partkey FROM part WHERE levenshtein(split_part(p_name, ' ', 1), 'green') <= 3")
def approximate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.levenshtein(F.split("p_name", " ")[0], F.lit("green")) <= 3).select("p_partkey")


# --- queries written as text --------------------------------------------------------------------------------


def _match(name: str, text: str, oracle: str) -> None:
    @query(name, _WITH + oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return M.match(table(spark, sf_dir, "documents"), text, ["text"]).select("doc_id")


_has = "SELECT doc_id FROM t GROUP BY doc_id HAVING "
_match("match_precedence", "the (scum OR license) NOT idiot", _has + "bool_or(term = 'the') AND (bool_or(term = 'scum') OR bool_or(term = 'license')) AND NOT bool_or(term = 'idiot')")
_match("match_or_below_and", "scum OR license AND rights", _has + "bool_or(term = 'scum') OR (bool_or(term = 'license') AND bool_or(term = 'rights'))")
_match("match_phrase_prefix", 'all + "rights" + reser*', "SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN t c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'all' AND b.term = 'rights' AND starts_with(c.term, 'reser')")
_match("match_first", "^the", "SELECT DISTINCT doc_id FROM t WHERE pos = 0 AND term = 'the'")
_match("match_near", "NEAR(the with, 3)", "SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 4 WHERE a.term = 'the' AND b.term = 'with'")
_match("match_near_three", "NEAR(the with of, 6)", "SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id JOIN t c ON a.doc_id = c.doc_id WHERE a.term = 'the' AND b.term = 'with' AND c.term = 'of' AND greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos) <= 7")


_type, _name = ("regexp_split_to_array(lower(p_%s), '[^a-z0-9]+')" % x for x in ("type", "name"))


@query("match_columns", f"SELECT p_partkey FROM part WHERE list_contains({_type}, 'promo') AND NOT list_contains({_name}, 'small') OR list_contains({_name}, 'bolt')")
def match_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match(table(spark, sf_dir, "part"), "-p_name : promo NOT {p_name} : small OR p_name : bolt", ["p_name", "p_type"]).select("p_partkey")
