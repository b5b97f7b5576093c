"""A training corpus from raw documents, in five stages that each write a table.

toxicity: rejected documents go; near_duplicates: one document of each class stays; repeats: words of
passages that repeat go; mixture: documents are taken as often as their source's target asks; tokens:
texts are encoded. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import balance, fmindex, pieces, simhash, toxic
from quillon.llm.common import discard, fresh, materialize
from quillon.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.5, repeated rows each. A null, empty or merely long text is clean; without
    labels nothing is rejected; an empty table stays empty. Columns of any names pass through."""
    result = fresh(docs, "_score")
    scored = toxic.score(docs, toxic.fit(docs, table(spark, sf_dir, "labels")), keep=docs.columns, result=result)
    return scored.filter(F.col(result) < 0.5).drop(result)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (5-word shingles, similarity 0.8): the one of the least id,
    null ids first; of repeated rows one. Null, empty and wordless texts are one class; texts of fewer than five
    words are one shingle; long texts are compared whole. Columns of any names pass through."""
    return simhash.representatives(docs, width=5, similarity=0.8)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without words that repeated windows of 35 words cover. Null, empty and short texts stay as
    they are; texts that are the same as another's are left empty; n_chars is counted again, null for a null text.
    Columns of any names pass through."""
    return fmindex.remove_repeats(docs, window=35).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them; those without words, null texts among them, are
    not taken. Rows that tie at a source's end share what is left. Columns of any names pass through."""
    return balance.mixed_copies(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and the number of these, none for a null or empty text; columns ids and
    n_tokens that were there give way. Repeated rows are encoded once each."""
    return pieces.encode(docs, tokenizer_path(), keep=docs.columns, results=["n_tokens", "ids"])


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", drop_repeats), ("mixture", mix_sources), ("tokens", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
