"""The registered queries of the training-data operators.

Each applies its operator, with production parameters, to a whole table and derives the columns that
its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balance, crosspoly, fmindex, mtree, pieces, shards, simhash, template, toxic, url_rules

# The rules that come before mined ones.
GIVEN_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = table(spark, sf_dir, "documents")
    return pieces.encode(docs, tokenizer_path(), keep=["doc_id"], results=["n_tokens", "ids_sha256", "decoded_sha256"])


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url. The labels mined are the verdicts of the given rules: those of
    the table labels say nothing about urls."""
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), GIVEN_RULES)


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every 20th vector."""
    return crosspoly.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24, its slot there, and its shard of 25."""
    return shards.assign(table(spark, sf_dir, "documents"), shards=24)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over 3-word shingles and its component of links within 2 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)


def op6_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return template.extract(table(spark, sf_dir, "pages"))


def op7_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest whole-number inner products of every 50th vector."""
    return mtree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and prediction."""
    docs = table(spark, sf_dir, "documents")
    scored = toxic.score(docs, toxic.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxic.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return balance.mix(table(spark, sf_dir, "documents"))


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that repeated windows of 35 words cover."""
    return fmindex.digests(table(spark, sf_dir, "documents"), window=35)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


#: The two queries that SQL expresses over whole tables.
OP7_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row AS query, q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v AS q JOIN v ON q.row <> v.row WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT row, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT row, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35) t),
s AS (SELECT row, i FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
c AS (SELECT DISTINCT row, i + o AS i FROM s, range(0, 35) AS t(o)),
x AS (SELECT row, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
k AS (SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN c USING (row, i) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN k USING (row)"""


def oracle_sql() -> dict[str, str]:
    return {"op7_mtree": OP7_SQL, "op10_fm_index": OP10_SQL}
